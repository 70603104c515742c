"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regex yields a Boolean query over trigrams of the lower-cased text: an OR of ANDs that every match must
satisfy. The index holds, for each trigram that the rules mention, which documents hold it. A document's postings stay
with its row, where a query intersects them: the rarest trigram of an AND is asked first, and the next one only if the
document holds that. So the postings never move, and no text is joined back to them. The regex of a rule runs only
over the texts of its candidates. A rule whose query is empty (no mandatory trigram, such as a run of hex digits)
scans every text.

Scale: everything happens in the row that holds the text, so nothing is shuffled, however many candidates there are.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_text, once, replaced, spans_of, table, united

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In the order that breaks ties between spans. Runs that would be too short are left out by the bound on their
#: length where no shorter match could hide another one; `assign` is checked after its match (SHORTEST).
RULES = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "stripe": r"[rs]k_live_[0-9A-Za-z]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
BASE = ("assign", "access", "hex")
_SKIP = r"""(?:[\s"'+,#>*;|]|\\[nrt])*+"""
#: What redacted() takes out: as RULES, but a private key with its body, up to the END line; without one before the
#: next BEGIN or END, up to where its header lines and runs of base64 end (a short run only as a whole line).
REDACTED = RULES | {
    "private_key": RULES["private_key"]
    + r"(?:(?:(?!-----(?:BEGIN|END)\x20)[\s\S])*+-----END\x20[A-Z ]*PRIVATE KEY-----"
    + rf"|(?:{_SKIP}(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:{_SKIP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    + r"(?:(?<=[A-Za-z0-9+/])\s*\n\s*[A-Za-z0-9+/]{1,15}={0,2}(?=[\x20\t\r]*(?![^\n])))?+(?:\s*+-----END\x20[A-Z ]*-----)?+)"
}
#: rule: (group, characters it must have at least)
SHORTEST = {"assign": (2, 6)}

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
_MOST = 64


def _simple(q: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MOST:  # either side alone is a weaker query, and still a right one
        return max(a, b, key=lambda q: min(map(len, q)))
    return _simple(frozenset(x | y for x in a for y in b))


def _of_strings(strings: set[str]) -> Query:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[set[str] | None, Query]:
    """The exact strings a sequence can match, if they are few; and the query that its matches satisfy."""
    run, query, exact = {""}, ANY, True

    def flush() -> None:
        nonlocal run, query, exact
        query, run, exact = _and(query, _of_strings(run)), {""}, False

    def add(strings: set[str] | None, inner: Query) -> None:
        nonlocal run, query
        if strings is not None and len(strings) * len(run) <= _MOST:
            run = {a + b for a in run for b in strings}
        else:
            flush()
            query = _and(query, inner)

    for op, arg in items:
        if op is sre.LITERAL:
            add({chr(arg).lower()}, ANY)
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            add({chr(a).lower() for _, a in arg} if len(arg) <= 8 else None, ANY)
        elif op is sre.SUBPATTERN:
            add(*_walk(arg[-1]))
        elif op is sre.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            together = _simple(frozenset().union(*(q for _, q in parts)))
            add(set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None, together)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings, inner_query = _walk(inner)
            if strings is not None and (least, most) == (0, 1):
                add(strings | {""}, ANY)
            elif strings is not None and least == most <= 8:
                for _ in range(least):
                    add(strings, inner_query)
            else:
                add(None, inner_query if least else ANY)
        elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            flush()
    if exact:
        return run, _of_strings(run)
    return None, _and(query, _of_strings(run))


def trigram_query(regex: str) -> Query:
    """An OR of ANDs of trigrams that the lower-cased text around any match must hold; ANY if there is none."""
    return _walk(sre_parse.parse(regex))[1]


#: Letters from the most to the least frequent; other characters are taken to be rarer
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def _rarity(trigram: str) -> int:
    return sum(_FREQUENT.index(c) if c in _FREQUENT else len(_FREQUENT) for c in trigram)


def plan(rules: dict[str, str]) -> dict[str, Query]:
    """The query of each rule that has one."""
    return {n: q for n, r in rules.items() if (q := trigram_query(r)) != ANY and frozenset() not in q}


def posted(low: Column, trigram: str) -> Column:
    """Whether the posting list of a trigram holds the row of this lower-cased text."""
    return F.contains(low, F.lit(trigram))


def candidate(low: Column, query: Query) -> Column:
    """Whether the row is in the union, over the query's alternatives, of the intersection of their posting lists."""
    each = sorted(sorted(a, key=lambda t: (-_rarity(t), t)) for a in query)
    return reduce(Column.__or__, (reduce(Column.__and__, (posted(low, t) for t in a)) for a in each))


def _found(rows: DataFrame, rules: dict[str, str], shortest: dict[str, tuple[int, int]]) -> DataFrame:
    """rows (with a text that is never null) with `secrets`."""
    queries, columns = plan(rules), rows.columns
    rows = rows.withColumn("_low", F.lower("text")).withColumns({f"_may_{n}": candidate(F.col("_low"), q) for n, q in queries.items()})
    rows = spans_of(rows, "text", {f"_s_{n}": (r, F.col(f"_may_{n}") if n in queries else None) for n, r in rules.items()})

    def named(i: int, n: str) -> Column:
        good = F.col(f"_s_{n}")
        if n in shortest:
            group, least = shortest[n]
            good = F.filter(good, lambda s: F.length(F.regexp_extract(s["value"], rules[n], group)) >= least)
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.lit(n).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return once(rows, secrets=F.array_sort(F.concat(*(named(i, n) for i, n in enumerate(rules))))).select(*columns, "secrets")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: dict[str, str] = RULES, shortest: dict[str, tuple[int, int]] = SHORTEST) -> DataFrame:
    """Each row's `doc_id`, `text` and `secrets`: array<struct<start, rank, kind, end, value>> by start, then rule.

    Null texts count as empty; null or repeated ids keep their rows and equal rows get equal results. An empty table
    gives an empty result; df's other columns are ignored. Spans of one rule never overlap, those of two may.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _found(rows, rules, shortest)


def redacted(df: DataFrame, text_col: str = "text", *, rules: dict[str, str] = REDACTED, shortest: dict[str, tuple[int, int]] = SHORTEST) -> DataFrame:
    """df's rows and columns with each secret replaced by [kind]; overlapping spans go as one, by the first's kind.

    Null texts stay null; null or repeated ids keep their rows. An empty table gives an empty result.
    """
    plain = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in plain.items()))
    text = F.col(plain[text_col])
    rows = rows.withColumn("text", F.coalesce(text, F.lit("")))
    kind = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("new"))
    found = once(_found(rows, rules, shortest), _spans=united(F.transform("secrets", kind)))
    found = once(found, _clean=F.when(F.size("_spans") > 0, replaced(F.col("text"), F.col("_spans"))).otherwise(text))
    return found.select(*((F.col("_clean") if c == text_col else F.col(n)).alias(c) for c, n in plain.items()))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(digest_text(of(*BASE)), 256).alias("base_sha256"), digest_text(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    def starts(n: str) -> str:
        return f"""list_transform(range(1, len(v_{n}) + 1), lambda i: {{'start': CAST(coalesce(list_sum(list_transform(g_{n}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v_{n}[1:i-1], lambda x: length(x))), 0) AS BIGINT), 'rank': {list(RULES).index(n)}, 'kind': '{n}', 'value': v_{n}[i]}})"""

    quoted = {n: r.replace("'", "''") for n, r in RULES.items()}
    found = ", ".join(f"regexp_extract_all(t, '{r}') v_{n}, string_split_regex(t, '{r}') g_{n}" for n, r in quoted.items())
    spans = "list_sort(list_filter(list_concat(" + ", ".join(starts(n) for n in RULES) + f"), lambda s: s.kind <> 'assign' OR length(regexp_extract(s.value, '{quoted['assign']}', 2)) >= 6))"
    say = lambda c: f"coalesce(list_aggregate(list_transform({c}, lambda s: s.kind || ':' || s.start || ':' || (s.start + length(s.value))), 'string_agg', ','), '')"
    base = "list_filter(spans, lambda s: s.rank < 3)"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda s: s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE)
    return f"WITH f AS (SELECT doc_id, {found} FROM (SELECT doc_id, coalesce(text, '') t FROM documents)), s AS (SELECT doc_id, {spans} AS spans FROM f) SELECT doc_id, {counts}, sha256({say(base)}) AS base_sha256, {say('spans')} AS spans FROM s"


QUERIES = {"op5_secrets": op5_secrets}
ORACLES = {"op5_secrets": _oracle()}
