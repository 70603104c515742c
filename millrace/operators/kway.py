"""k-way merge sort of pages in closed form: where each value goes, and how far each run is when a page is full.

Values sit at (page, slot), PAGE to a page. The pages make k runs: each has a k-th of them, the last one the rest too;
with fewer pages than runs each page is a run. Equal values come from the lowest run first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ranked

PAGE = 10


def run_of(page: Column, pages: int, k: int) -> Column:
    """The run of a page, numbered from 0."""
    if pages < k:
        return page.cast("int")
    return F.least(F.floor(page / F.lit(pages // k)), F.lit(k - 1)).cast("int")


def sorted_pages(df: DataFrame, value: str, order: list[Column], buckets: Column) -> DataFrame:
    """df with `out_page` and `out_slot` of the sorted output, by (value, order). buckets: monotone in value, as for ranked()."""
    rows = ranked(df, F.col(value), *order, buckets=buckets)
    at = F.col("rank") - 1
    return rows.withColumns({"out_page": ((at - F.pmod(at, F.lit(PAGE))) / PAGE).cast("long"), "out_slot": F.pmod(at, F.lit(PAGE)).cast("long")})


def merge_states(df: DataFrame, value: str, run: str, pos: str, buckets: Column) -> DataFrame:
    """(out_page, run, page, slot): for each full page of the output the cursor of each run that isn't used up yet.

    pos numbers a run's sorted values from 0. A page is full with the value of rank PAGE * (out_page + 1), and the
    cursors are those before that value's run moves on; so a run stands at the count of its values of lower rank.
    """
    rows = ranked(df.select(value, run, pos), F.col(value), F.col(run), F.col(pos), buckets=buckets)
    rows = rows.withColumn("out_page", ((F.col("rank") - 1 - F.pmod(F.col("rank") - 1, F.lit(PAGE))) / PAGE).cast("long"))
    total = rows.groupBy(run).agg(F.count("*").alias("length"))
    # the value that fills a page isn't counted yet
    taken = rows.groupBy("out_page", run).agg(F.count_if(F.pmod(F.col("rank"), F.lit(PAGE)) != 0).alias("before"), F.count("*").alias("n"))
    full = rows.where(F.pmod(F.col("rank"), F.lit(PAGE)) == 0).select("out_page").distinct()
    grid = full.join(F.broadcast(total), F.lit(True)).join(taken, ["out_page", run], "left").fillna(0, ["before", "n"])
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(run).orderBy("out_page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    states = grid.withColumn("at", earlier + F.col("before")).where(F.col("at") < F.col("length"))
    return states.select("out_page", run, ((F.col("at") - F.pmod(F.col("at"), F.lit(PAGE))) / PAGE).cast("long").alias("page"), F.pmod(F.col("at"), F.lit(PAGE)).alias("slot"))
