"""URL filters: rules by host and path, then a list of URLs behind a blocked Bloom filter.

A URL is looked up by its expressions: the canonical URL, its path's folders up to the root, and the root of each
parent domain. The listed URLs' hashes set bits in a Bloom filter whose blocks are rows (block, four 64-bit words);
an expression reads a single block. What passes is a possible hit, and an exact hash join with the listed
canonical URLs removes the false positives.

Scale: the filter has about 16 bits a listed URL. It is broadcast within `max_broadcast` rows and else joined by
block. Only possible hits go on, each URL once however many pages have it, so a hot host costs no more than its
different URLs. The pages themselves keep to the rows they are read in, until the few blocked URLs join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, kept, sized, table

#: (verdict, rule): host and path, as the contract fixes them
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Names that lists of junk sites hold, and folders and pages of junk on sites that are otherwise fine
JUNK = (
    "casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x", "win-prizes", "fast-loans", "click-bait", "fake-watches", "lucky-slots", "miracle-diet",
    "pirate-films", "phish-login", "crypto-double", "link-farm", "pop-ads", "scam-deals", "hot-dates", "poker-room",
)
JUNK_FOLDERS = ("ads", "banner/ads", "sponsored", "out/affiliate", "cgi-bin/track.php")
ENDINGS = ("com", "net", "org", "info", "biz")
#: What the query lists: the roots of such sites under common endings, and such folders under two sites
LISTED = (
    *(f"http://{name}.example.{tld}/" for name in JUNK for tld in ENDINGS),
    *(f"http://{host}/{folder}" for host in ("news.example.com", "shop.example.net") for folder in JUNK_FOLDERS),
)
WORDS, HASHES, BITS_A_URL = 4, 4, 16
_SEED = 20_011


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://` or for a null URL."""
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Host without user, port and a leading www., and the path without repeated slashes and a last one."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.", "")
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    return F.concat(bare, F.when(clean == "", "/").otherwise(clean))


def expressions(url: Column, folders_listed: list[int], labels_listed: list[int]) -> Column:
    """What a canonical URL is looked up by: itself, the folders above it, the roots of its domains.

    Only folders of a depth, and domains of a number of labels, that stand in the list can be in it. So a URL of very
    many folders or labels costs no more than the list's own variety.
    """
    host, path = F.substring_index(url, "/", 1), F.substr(url, F.instr(url, "/"))
    folders, labels = F.split(path, "/", -1), F.split(host, r"\.", -1)
    above = [F.when(F.size(folders) > d, F.concat(host, F.array_join(F.slice(folders, 1, d), "/"))) for d in folders_listed]
    roots = [F.when(F.size(labels) >= n, F.concat(F.substring_index(host, ".", -n), F.lit("/"))) for n in labels_listed]
    return F.array_distinct(F.array_compact(F.array(url, *above, *roots)))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the words of its mask in it."""
    h = F.xxhash64(key, F.lit(_SEED))
    at = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(HASHES)]
    words = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for a in at:
            word = word.bitwiseOR(F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.pmod(F.xxhash64(key), F.lit(blocks)), words


def bloom(listed: DataFrame, count: int, key: str = "key") -> tuple[DataFrame, int]:
    """(block, w0, w1, ...) for the keys listed, and the number of blocks."""
    blocks = max(1, -(-count * BITS_A_URL // (64 * WORDS)))
    block, words = _bits(F.col(key), blocks)
    rows = listed.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def listed_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", *, max_broadcast: int = 500_000) -> DataFrame:
    """(url): those of the canonical `urls` (column url) that an entry of `listed` (raw URLs in url_col) covers.

    Null or unreadable listed URLs list nothing, repeated ones count once.
    """
    host, path = host_path(F.col(url_col))
    keys = kept(listed.select(host.alias("host"), path.alias("path")).where("host <> ''").select(canonical(F.col("host"), F.col("path")).alias("key")).distinct())
    count = keys.count()
    if not count:
        return urls.select("url").limit(0)
    filter_, blocks = bloom(keys, count)
    filter_ = kept(filter_)
    filter_ = sized(filter_, filter_.count(), max_broadcast)
    # the depths of listed folders and the labels of listed hosts: as many rows as they vary
    host, path = F.substring_index("key", "/", 1), F.substr("key", F.instr("key", "/"))
    folders = [r[0] for r in keys.where(path != "/").select(F.size(F.split(path, "/", -1))).distinct().collect()]
    labels = [r[0] for r in keys.where(path == "/").select(F.size(F.split(host, r"\.", -1))).distinct().collect()]
    asked = urls.select("url", F.explode(expressions(F.col("url"), sorted(folders), sorted(labels))).alias("key"))
    block, words = _bits(F.col("key"), blocks)
    asked = asked.select("url", "key", block.alias("of"), *(w.alias(f"m{i}") for i, w in enumerate(words)))
    all_set = F.lit(True)
    for i in range(WORDS):
        all_set &= F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
    possible = asked.join(filter_, (F.col("of") == F.col("block")) & all_set).select("url", "key")
    exact = sized(keys, count, max_broadcast)
    return possible.join(exact, "key", "left_semi").select("url").distinct()


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null; of equally long ones the first."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judge(df: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", *, listed_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, max_broadcast: int = 500_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of df.

    The verdict is the rule's; without a rule a page is blocked if the list covers its URL, else allowed. A null URL, or
    one without `://`, has an empty host and path and is allowed. Rows with null or repeated ids are judged by
    themselves. An empty table gives an empty result, an empty list blocks nothing; df's other columns are ignored.
    """
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = kept(rows.withColumns({"_url": canonical(F.col("host"), F.col("path")), "rule": fitting_rule(F.col("host"), F.col("path"), rules)}))
    hits = kept(listed_urls(rows.where("host <> ''").select(F.col("_url").alias("url")).distinct(), listed, listed_col, max_broadcast=max_broadcast))
    hits = sized(hits, hits.count(), max_broadcast).withColumn("_hit", F.lit(True))
    rows = rows.join(hits, rows["_url"] == hits["url"], "left")
    is_listed = F.coalesce("_hit", F.lit(False))
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(is_listed, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), is_listed.alias("listed"))


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    return judge(table(spark, folder, "pages"), listed)


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fit = lambda r: f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')"
    known = [u.split("/", 3)[2:] for u in LISTED]
    hosts = ", ".join(f"'{h}'" for h, p in known if not p)
    folders = ", ".join(f"'{h}/{p}'" for h, p in known if p)
    clean = "regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')"
    bare = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^www\.', '')"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT *, {bare} AS bare, {clean} AS clean FROM h),
r AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {fit(r)} THEN '{r}'" for _, r in rules)} END AS rule,
  len(list_filter([{hosts}], lambda x: bare = x OR ends_with(bare, '.' || x))) > 0 OR len(list_filter([{folders}], lambda x: starts_with(bare || clean || '/', x || '/'))) > 0 AS listed FROM l)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


QUERIES = {"op9_urls": op9_urls}
ORACLES = {"op9_urls": _oracle()}
