"""A training corpus from `documents`: quality rules, near-dedup, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import mixing, pieces, quality, secrets, simhash
from millrace.llm.common import kept, sized, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_BROADCAST = 500_000
#: Bytes of texts that the last stage works off at a time, less than by default as other stages' workers still hold memory
SLICE = 4_000_000


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Null and empty texts have no words, so they fail; repeated rows are judged alike."""
    found = quality.judge(docs, carry=("doc_id", "lang", "source"))
    return _counted(found.where("kept").withColumnRenamed("clean_text", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more): the one with the smallest id; a null id comes last."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind. Null texts stay null, repeated rows stay."""
    return _counted(secrets.redacted(docs.select(*COLUMNS)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Copies are counted for (id, text, source). Rows that share these divide the copies among them, the earlier one by
    language and length first. Null texts have no words, and like all of a source without words they are not taken.
    """
    docs = docs.select(*COLUMNS)
    taken = kept(mixing.mix(docs).where("copies > 0").select("_id", "_h", "source", "copies", "n"))
    few = sized(taken, taken.count(), MAX_BROADCAST).withColumnRenamed("source", "_source")
    rows = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(few, rows["doc_id"].eqNullSafe(few["_id"]) & (rows["_key"] == few["_h"]) & rows["source"].eqNullSafe(few["_source"]))
    once = rows.where("n = 1")
    if not taken.where("n > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("_id", "_h", "_source").orderBy("lang", "n_chars"))
        share = F.expr("copies div n") + (nth <= F.col("copies") % F.col("n")).cast("long")
        once = once.unionByName(rows.where("n > 1").withColumn("copies", share))
    return once.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, how many these are, and whether decoding them gives the text back."""
    same = lambda model, text, ids: model.decode(ids) == text.replace(pieces.WRITTEN, pieces.MARK)
    derive = {"token_ids": ("array<int>", lambda model, text, ids: ids), "n_tokens": ("bigint", lambda model, text, ids: len(ids)), "round_trip": ("boolean", same)}
    return pieces.encode(docs.select(*COLUMNS), derive=derive, slice_bytes=SLICE)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]
#: SQL can't express the balanced sample or the Viterbi pass
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
