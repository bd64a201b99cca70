"""The first n rows of an order, for any n, without passing them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tacit.operators.indexing import numbered
from tacit.scratch import store

# Buckets of a histogram, whose counts come to the driver.
BUCKETS = 4096
# Rows of the bucket with the cut that are sorted rather than counted again.
CUT_ROWS = 100_000


def first_rows(df: DataFrame, key: Column, ties: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ascending ``key`` (a bigint), then by ``ties``, which tell rows apart.

    Histograms of the key find the bucket in which the cut lies, ever finer; rows before it are
    taken as they are, and only the rows of that bucket are sorted, over all tasks.
    """
    held = store(df.withColumn("_key", key.cast("bigint")), "select")
    rows = held.frame
    if n <= 0 or held.rows <= n:
        return rows.drop("_key").limit(0) if n <= 0 else rows.drop("_key")
    low, high = rows.agg(F.min("_key"), F.max("_key")).first()
    wanted, inside = n, held.rows
    while low < high and inside > CUT_ROWS:
        width = (high - low) // BUCKETS + 1
        bucket = F.floor((F.col("_key") - F.lit(low)) / F.lit(width)).cast("int")
        bucket = F.when(F.col("_key").between(low, high), bucket).alias("_bucket")
        counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where("_bucket IS NOT NULL")
        for at, count in sorted(tuple(row) for row in counts.collect()):
            if wanted <= count:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                inside = count
                break
            wanted -= count
    cut = rows.where(F.col("_key").between(low, high)).orderBy("_key", *ties)
    before = rows.where(F.col("_key") < low).drop("_key")
    last = numbered(cut).where(F.col("_place") < wanted).select(*before.columns)
    return before.unionByName(last)
