"""Item popularity and the confidence of missing feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tacit.operators.filters import count_by


def item_popularity(interactions: DataFrame, item_col: str = "item_idx") -> DataFrame:
    """``(item, f_i)``: the item's share of all rows."""
    counts = count_by(interactions, item_col)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(item_col, (F.col("n").cast("double") / total).alias("f_i"))


def item_confidence(
    popularity: DataFrame, c0: float = 512.0, alpha: float = 0.4, item_col: str = "item_idx"
) -> DataFrame:
    """``(item, c_i)`` with c_i = c0 * f_i**alpha / sum of f_j**alpha."""
    smoothed = popularity.select(item_col, F.pow("f_i", F.lit(float(alpha))).alias("s"))
    total = smoothed.agg(F.sum("s")).scalar()
    return smoothed.select(item_col, (F.col("s") / total * F.lit(float(c0))).alias("c_i"))
