"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans (email, ip, card, phone) are the protected entities. Corpus co-occurrence then tells which ordinary
terms reveal them: around each entity the terms of a window are gathered, and with

    M      = corpus terms / window_terms          (how many windows the corpus holds)
    p(c)   = distinct windows of entity c (one a text) / M
    p(t)   = corpus occurrences of term t / M
    p(c,t) = distinct windows of c that hold t / M

a term discloses PMI(c;t) = log2(p(c,t) / (p(c) p(t))) of the entity's information IC(c) = -log2 p(c). Terms that
reach `threshold` of IC(c) become spans of kind `term`; one window of c is evidence enough, as most entities stand in
one text only (a larger `min_support` asks for that many distinct windows). Terms are generalised if a taxonomy names a broader term, else removed.

Windows only estimate co-occurrence: a disclosing term is marked wherever it stands in a text that holds its entity.

Scale: only the texts that hold a base span are kept aside and joined with their terms; the others stay where they
are read. Else windows (a few dozen characters around an entity) and counts move. A word of the corpus is counted by
name only if it stands in some window, so the counts are combined before the shuffle to a row a term and task. The
terms of an entity meet its texts as one list, so an entity in very many texts costs a row a text, not a row a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_text, found_spans, kept, on_row, once, replaced, sized, spans_of, table, united

KINDS = ("email", "ip", "card", "phone")
#: A match can only start where a run of its first characters starts, or where the last match ended; possessive
#: repeats give back nothing that could match. Both keep the search linear in texts without spaces.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 4)).cast("int") <= 255
        return F.forall(F.split(value, r"\."), part)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with `base`: array<struct<kind, start, end, value>>, by kind as listed, then start."""
    at_sign, digit = F.contains(F.col(text), F.lit("@")), F.col(text).rlike("[0-9]")
    df = spans_of(df, text, {f"_{k}": (PATTERNS[k], {"email": at_sign, "phone": F.contains(F.col(text), F.lit("+"))}.get(k, digit)) for k in KINDS})
    def named(kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda s: _valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    each = [named(k) for k in KINDS]
    return once(df, base=F.concat(*each)).drop(*(f"_{k}" for k in KINDS))


def _windows(base: Column, text: Column, width: int) -> tuple[Column, Column]:
    """The spans in order; for each of them (as column _ordered) its entity and the text up to `width` code points
    before and after, up to the next span."""
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    entity = lambda s: F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))

    def window(s: Column, i: Column) -> Column:
        before = F.greatest(F.coalesce(F.get(F.col("_ordered"), i - 1)["end"], F.lit(0)), s["start"] - width)
        after = F.least(F.coalesce(F.get(F.col("_ordered"), i + 1)["start"], F.length(text)), s["end"] + width)
        return F.struct(
            entity(s).alias("entity"), before.alias("l_at"), F.substring(text, before + 1, F.greatest(s["start"] - before, F.lit(0))).alias("l"),
            s["end"].alias("r_at"), F.substring(text, s["end"] + 1, F.greatest(after - s["end"], F.lit(0))).alias("r"),
            (before == s["start"] - width).alias("l_cut"), (after == s["end"] + width).alias("r_cut"),
        )

    return ordered, F.transform(F.col("_ordered"), window)


def _without(df: DataFrame, text: str) -> DataFrame:
    """df with _plain: the text with spaces in place of its base spans, so that no term reaches into one."""
    spans = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("new"))))
    blank = F.transform("_united", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("new")))
    df = once(df, _united=united(spans)).withColumn("_united", blank)
    return once(df, _plain=replaced(F.col(text), F.col("_united"))).drop("_united")


def context_terms(df: DataFrame, text: str, width: int) -> DataFrame:
    """(_id, _h, entity, window, term, start, end): the whole terms around each base span, or one null term; window names its text."""
    ordered, windows = _windows(F.col("base"), F.col(text), width)
    rows = df.withColumn("_ordered", ordered).select("_id", "_h", F.explode(windows).alias("w")).select("_id", "_h", "w.*")
    rows = spans_of(spans_of(rows, "l", {"lt": (TERM, None)}), "r", {"rt": (TERM, None)})
    left = F.filter("lt", lambda s: ~F.col("l_cut") | (s["start"] > 0))
    right = F.filter("rt", lambda s: ~F.col("r_cut") | (s["end"] < F.length("r")))
    moved = lambda spans, at: F.transform(spans, lambda s: F.struct(F.lower(s["value"]).alias("term"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
    rows = rows.select("_id", "_h", "entity", F.xxhash64("l", "r").alias("window"), F.explode_outer(F.concat(moved(left, F.col("l_at")), moved(right, F.col("r_at")))).alias("t"))
    return rows.select("_id", "_h", "entity", "window", "t.*")


def disclosures(context: DataFrame, texts: DataFrame, text: str, threshold: float, min_support: int, window_terms: int, max_broadcast: int) -> DataFrame:
    """(entity, term, ratio) of the terms that disclose at least `threshold` of an entity's information."""
    context = context.where("term IS NOT NULL")
    # one window for each text: neither copies of a text nor repeats within it are evidence
    apart = lambda *by: context.groupBy(*by, "_h").agg(F.min("window").alias("window")).select(*by, "window").distinct().groupBy(*by)
    joint = apart("entity", "term").agg(F.count("*").alias("f_ct")).where(F.col("f_ct") >= min_support)
    alone = apart("entity").agg(F.count("*").alias("f_c"))
    joint = kept(joint)
    wanted = kept(joint.select("term").distinct().withColumn("hit", F.lit(True)))
    every = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    if (n := wanted.count()) > max_broadcast:  # combined first, as both sides move
        every = every.groupBy("term").agg(F.count("*").alias("n"))
    else:
        every = every.withColumn("n", F.lit(1).cast("long"))
    # one row for each wanted term, and one for all others together
    every = every.join(sized(wanted, n, max_broadcast), "term", "left").select(F.when(F.col("hit"), F.col("term")).alias("term"), "n")
    counts = kept(every.groupBy("term").agg(F.sum("n").alias("f_t")))
    total = (counts.agg(F.sum("f_t")).first()[0] or 0) / window_terms
    ratio = F.log2(F.col("f_ct") * F.lit(total) / (F.col("f_c") * F.col("f_t"))) / F.log2(F.lit(total) / F.col("f_c"))
    return joint.join(alone, "entity").join(counts, "term").where(F.col("f_c") < total).withColumn("ratio", ratio).where(F.col("ratio") >= threshold).select("entity", "term", "ratio")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 64, threshold: float = 0.5, min_support: int = 1, window_terms: int = 16, taxonomy: DataFrame | None = None, max_broadcast: int = 200_000) -> DataFrame:
    """Each row's `doc_id`, `text`, `base` spans and `terms`: array<struct<kind, start, end, replacement>>.

    A text's terms are all occurrences, outside base spans, of the terms that disclose one of its entities.

    taxonomy: (term, general), one broader term each; without one a disclosing term is removed. Of a term's rows the
    smallest general term counts.
    Null texts count as empty; null or repeated ids keep their rows, and equal rows get equal results. An empty
    table gives an empty result. Other columns of df are ignored, whatever their names. An entity seen in fewer
    than min_support distinct windows discloses nothing; in a tie at the threshold the term counts as disclosing.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = base_spans(rows, "text")
    private = kept(rows.where(F.size("base") > 0).withColumns({"_id": F.col("doc_id"), "_h": F.xxhash64("text")}))
    context = kept(context_terms(private, "text", width))
    strong = disclosures(context, rows, "text", threshold, min_support, window_terms, max_broadcast)
    if taxonomy is not None:
        broader = taxonomy.groupBy(F.lower("term").alias("term")).agg(F.min("general").alias("general"))
        strong = strong.join(broader, "term", "left")
    else:
        strong = strong.withColumn("general", F.lit(None).cast("string"))
    # the disclosing terms of each text that holds their entity, wherever they stand in it
    word = F.struct("term", F.coalesce("general", F.lit("")).alias("replacement"))
    words = strong.groupBy("entity").agg(F.collect_set(word).alias("words"))
    holders = context.select("_id", "_h", "entity").distinct()
    terms = holders.join(words, "entity").groupBy("_id", "_h").agg(F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    found = private.join(terms, on_row(private, terms), "left").select("doc_id", "text", "base", "words")
    found = _without(found, "text").withColumn("_plain", F.when(F.col("words").isNotNull(), F.col("_plain")))
    found = found.withColumns({"_words": F.regexp_extract_all("_plain", F.lit(TERM), F.lit(0)), "_gaps": F.split("_plain", TERM, -1)})
    spans = found_spans(F.col("_words"), F.col("_gaps"), lambda v: F.map_contains_key("words", F.lower(v)))
    kind = "array<struct<kind:string,start:int,end:int,replacement:string>>"
    named = F.transform(spans, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.element_at("words", F.lower(s["value"])).alias("replacement")))
    return rows.where(F.size("base") == 0).select("doc_id", "text", "base", F.array().cast(kind).alias("terms")).unionByName(once(found, terms=named.cast(kind)).select("doc_id", "text", "base", "terms"))


def sanitised(scanned: DataFrame) -> DataFrame:
    """scan()'s rows with `clean_text`: base spans become marks, disclosing terms their replacement; overlapping spans go as one, by the first's."""
    marks = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    spans = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), marks[s["kind"]].alias("new"))),
            F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("new"))),
        )
    )
    return once(once(scanned, _spans=united(spans)), clean_text=replaced(F.col("text"), F.col("_spans"))).drop("_spans")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = sanitised(scan(table(spark, folder, "documents")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"),
        digest_text(F.concat(bare(F.col("base")), bare(F.col("terms")))).alias("spans"), F.size("terms").cast("long").alias("n_term"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )


QUERIES = {"op1_pii": op1_pii}
