"""Dense integer ids without a driver-side label list or a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tacit.scratch import materialize

# monotonically_increasing_id keeps the partition above this bit and the row in it below.
ROW_BITS = 33


def dense_index(
    df: DataFrame,
    col: str,
    order: str = "frequency",
    order_col: str | None = None,
    idx_col: str = "idx",
) -> DataFrame:
    """Map the values of ``col`` to 0..n-1; returns ``(col, idx_col)``.

    ``frequency``: descending row count, ties ascending by the value as a string.
    ``first_seen``: ascending by the smallest ``order_col`` of a value, ties as above.

    Indices are ints: more than 2**31 - 1 distinct values are an error.

    One range sort over the distinct values is written with (partition, row) positions; the
    partition sizes, a table of one row per sort partition, then turn positions into ranks.
    """
    present = df.where(F.col(col).isNotNull())
    if order == "frequency":
        keys = present.groupBy(col).agg(F.count(F.lit(1)).alias("_key"))
        first = F.desc("_key")
    elif order == "first_seen":
        if order_col is None:
            raise ValueError("first_seen needs order_col")
        keys = present.groupBy(col).agg(F.min(order_col).alias("_key"))
        first = F.asc("_key")
    else:
        raise ValueError(f"unknown order {order!r}")
    ordered = keys.orderBy(first, F.col(col).cast("string").asc(), F.asc(col)).select(col)
    return numbered(ordered).select(col, F.col("_place").cast("int").alias(idx_col))


def numbered(ordered: DataFrame) -> DataFrame:
    """Add ``_place``, the place of a row in a frame that ends with a global sort, from 0.

    The sorted rows are written with (partition, row) positions; partition sizes turn them into
    places.
    """
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "index")
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    row = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per sort partition: bounded by the shuffle width, whatever the data size.
    return (
        placed.select(*ordered.columns, part, row.alias("_row"))
        .join(F.broadcast(starts), "_part")
        .select(*ordered.columns, (F.col("_start") + F.col("_row")).alias("_place"))
    )


def apply_index(
    df: DataFrame, users: DataFrame, items: DataFrame, user_col: str, item_col: str
) -> DataFrame:
    """Replace raw ids by ``user_idx`` and ``item_idx`` (the mappings' second columns)."""
    users = users.toDF(user_col, "user_idx")
    items = items.toDF(item_col, "item_idx")
    rest = [c for c in df.columns if c not in (user_col, item_col)]
    return df.join(users, user_col).join(items, item_col).select("user_idx", "item_idx", *rest)
