"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to their parents. Self-joins double the length of every pointer until each one has passed its root
(log2 of the deepest thread), adding up scores on the way; so every leaf learns the score of its whole branch.
Branches are ranked for each conversation, and the same pointers, halved again, enumerate the messages of the
chosen paths. Each path becomes one string.

The template: `### role: text</turn>` and a line feed for each turn. In texts and roles a backslash becomes two,
`</turn>` becomes `\\l/turn>` and `###` becomes `\\h\\h\\h`; in roles a colon becomes `\\c`. So no control string can
stand in an escaped text, and unescape() restores it exactly.

Scale: pointer tables hold ids and numbers, never texts, and are dropped when used. Texts move twice: to the chosen
paths, joined on (conversation, message), which spreads a conversation with a third of all messages over all tasks;
and to the path that they become a part of. Only a path's own string is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, kept, table

END = "</turn>\n"
HEAD = "### "
LOSS_ROLE = "assistant"
#: So many low bits of a turn are put in order by one task
TURN_BITS = 12


def escape(c: Column, colon: bool = False) -> Column:
    for old, new in (("\\", "\\\\"), ("</turn>", "\\l/turn>"), ("###", "\\h\\h\\h"), *([(":", "\\c")] if colon else [])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def unescape(c: Column) -> Column:
    def plain(part: Column) -> Column:
        for new, old in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(new), F.lit(old))
        return part

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def _doubled(nodes: DataFrame) -> list[DataFrame]:
    """[(c, m, a, s, d)]: in table k, a is the ancestor 2^k above m, or null past the root; s and d add up the scores and the number of messages from m to below a."""
    parents = nodes.select(F.col("c").alias("pc"), F.col("m").alias("pm"))
    first = nodes.join(parents, (F.col("c") == F.col("pc")) & (F.col("p") == F.col("pm")), "left")
    levels = [kept(first.select("c", "m", F.col("pm").alias("a"), F.col("score").alias("s"), F.lit(1).cast("long").alias("d")))]
    still, before = levels[0].where("a IS NOT NULL").count(), None
    # in a tree some pointer passes its root each time; those that are left when none does hang on cycles
    while still and still != before:
        last = levels[-1]
        up = last.select(F.col("c").alias("uc"), F.col("m").alias("um"), F.col("a").alias("ua"), F.col("s").alias("us"), F.col("d").alias("ud"))
        longer = last.where("a IS NOT NULL").join(up, (F.col("c") == F.col("uc")) & (F.col("a") == F.col("um")))
        longer = longer.select("c", "m", F.col("ua").alias("a"), (F.col("s") + F.col("us")).alias("s"), (F.col("d") + F.col("ud")).alias("d"))
        levels.append(kept(longer.unionByName(last.where("a IS NULL"))))
        before, still = still, levels[-1].where("a IS NOT NULL").count()
    return levels


def _ranked(leaves: DataFrame, top: int) -> DataFrame:
    """(c, rank, m): the best branches of each conversation; ties go to the longer branch, then to the smaller message."""
    best = [F.col("s").desc(), F.col("d").desc(), F.col("m")]
    if top == 1:
        one = leaves.groupBy("c").agg(F.min(F.struct((-F.col("s")).alias("s"), (-F.col("d")).alias("d"), "m")).alias("x"))
        return one.select("c", F.lit(1).alias("rank"), F.col("x.m").alias("m"))
    # a conversation's leaves are first thinned in 64 parts, so no task ranks them all
    parts = leaves.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(64)))
    few = parts.withColumn("r", F.row_number().over(Window.partitionBy("c", "part").orderBy(*best))).where(F.col("r") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(*best))).where(F.col("rank") <= top).select("c", "rank", "m")


def format_trees(df: DataFrame, conv: str = "conv_id", message: str = "msg_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None, *, top: int = 1, replies: DataFrame | None = None) -> DataFrame:
    """A row for each chosen path: `conv`, rank, n_turns, formatted, loss_spans (array<struct<start, end>>, code points).

    Message ids are unique in their conversation; of rows that repeat one, the smallest by (parent, role, hash of text)
    stays. A null conversation is one of its own; rows without a message id are left out. Null texts and roles are
    empty, null scores 0. A message whose parent is missing is a root. Messages on or below a cycle of replies belong
    to no path. Of branches with equal scores the longer one comes first, then the one that ends in the smaller
    message. An empty table gives an empty result; other columns are ignored.

    replies: (conv, message, parent and, if named, score) apart from the texts, one row a message. Rows of df that
    repeat a message are then turns of their own, one after the other.
    """

    def keyed(rows: DataFrame) -> list[Column]:
        return [F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("c"), F.col(message).alias("m")]

    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    said = [F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")]
    if replies is None:
        rows = df.select(F.col(conv).alias("conv"), *keyed(df), F.col(parent).alias("p"), *said, s.alias("score")).where("m IS NOT NULL")
        rows = rows.withColumn("h", F.xxhash64("text"))
        nodes = rows.groupBy("c", "m").agg(F.min(F.struct("p", "role", "h", "score")).alias("x")).select("c", "m", "x.p", "x.score")
        order = ["at", "p", "role", "h", "score"]
    else:
        rows = df.select(F.col(conv).alias("conv"), *keyed(df), *said).where("m IS NOT NULL")
        nodes = replies.select(*keyed(replies), F.col(parent).alias("p"), s.alias("score")).where("m IS NOT NULL")
        order = ["at"]
    nodes = kept(nodes)
    levels = _doubled(nodes)
    replied = nodes.where("p IS NOT NULL").select("c", F.col("p").alias("m")).distinct()
    leaves = levels[-1].where("a IS NULL").join(replied, ["c", "m"], "left_anti")
    path = kept(_ranked(leaves, top).withColumn("up", F.lit(0).cast("long")))
    for k in range(len(levels) - 2, -1, -1):  # the last table has no ancestors left
        above = levels[k].where("a IS NOT NULL").select(F.col("c").alias("lc"), F.col("m").alias("lm"), "a")
        more = path.join(above, (F.col("c") == F.col("lc")) & (F.col("m") == F.col("lm"))).select("c", "rank", F.col("a").alias("m"), (F.col("up") + (1 << k)).alias("up"))
        shorter, path = path, kept(path.unionByName(more))
        dropped(shorter)
    dropped(nodes, *levels)
    turns = path.join(rows, ["c", "m"]).withColumn("at", -F.col("up")).drop("m", "up")
    in_order = Window.partitionBy("c", "rank").orderBy(*order)
    if replies is None:
        turns = turns.withColumn("first", F.coalesce(F.lag("at").over(in_order) != F.col("at"), F.lit(True))).where("first").drop("p", "h", "score")
    turns = turns.withColumn("piece", F.concat(F.lit(HEAD), escape(F.col("role"), colon=True), F.lit(": "), escape(F.col("text")), F.lit(END)))
    end = F.sum(F.length("piece").cast("long")).over(Window.partitionBy("c", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(END)
    turns = turns.withColumn("end", end).withColumn("start", F.col("end") - F.length(escape(F.col("text"))))
    # groupBy has the window's keys, so the rows don't move again; the running ends keep equal turns in one order
    whole = turns.groupBy("c", "rank").agg(F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("at", "end", "piece", "role", "start"))).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select(
        F.col("conv").alias(conv), "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss_spans"),
    )


def chained(df: DataFrame, conv: str, turn: str, message: str, parent: str) -> DataFrame:
    """(conv, message, parent): each message replies to the one before it by (turn, message); message is a struct that begins with turn.

    A long conversation is put in order in parts of 2^TURN_BITS turns; one row a part tells where the part before ended.
    """
    rows = df.select(conv, message, F.shiftright(F.col(turn).cast("long"), TURN_BITS).alias("part")).distinct()
    last = rows.groupBy(conv, "part").agg(F.max(message).alias("last"))
    before = last.select(F.col(conv).alias("_conv"), F.col("part").alias("_part"), F.lag("last").over(Window.partitionBy(conv).orderBy("part")).alias("before"))
    rows = rows.withColumn(parent, F.lag(message).over(Window.partitionBy(conv, "part").orderBy(message)))
    rows = rows.join(before, F.col(conv).eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part")))
    return rows.select(conv, message, F.coalesce(parent, "before").alias(parent))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped."""
    parts = F.split(formatted, END, -1)

    def turn(part: Column) -> Column:
        body = F.substring(part, len(HEAD) + 1, F.length(part))
        role = F.substring_index(body, ": ", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.length(role) + 3, F.length(body))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))), ""))


#: What both turns of conversation -7 say.
PROBE = r"\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    # a message is named by its turn and the beginning of a hash of what it says
    named = F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    rows = rows.unionByName(probe).withColumn("msg_id", F.struct("turn", F.conv(F.substring(named, 1, 15), 16, 10).cast("long").alias("h")))
    out = format_trees(rows, replies=chained(rows, "conv_id", "turn", "msg_id", "parent_id"))
    out = out.withColumns({"turns": parsed(F.col("formatted")), "loss": under_mask(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({}, '\\', '\\\\'), '</turn>', '\\l/turn>'), '###', '\\h\\h\\h')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')) v
), r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(coalesce(role, '') || chr(10) || coalesce(text, '')), 1, 15)) AS i FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum({len(HEAD) + 2 + len(END)} + length(replace({_ESC.format('role')}, ':', '\\c')) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

QUERIES = {"op2_chat": op2_chat}
ORACLES = {"op2_chat": ORACLE}
