"""Per-entity histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows gathered into one list; a longer history continues in further parts.
PART_ROWS = 100_000


def entity_history(interactions: DataFrame, own: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``(own, part, events)``: the (counterpart, rating) rows of an entity, sorted.

    A history of up to ``part_rows`` rows is part 0.  A longer one is spread over several parts
    by a hash of counterpart and copy number, so no list outgrows one task.
    """
    other = "item_idx" if own == "user_idx" else "user_idx"
    rating = F.col("rating") if "rating" in interactions.columns else F.lit(1.0)
    # Copies are first added up (on the map side too), then cut into runs of part_rows.
    pairs = interactions.groupBy(own, other, rating.alias("rating")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = (
        interactions.groupBy(own)
        .agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > part_rows)
        .select(own, F.ceil(F.col("_size") / F.lit(part_rows)).alias("_parts"))
    )
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / part_rows))).alias("run")
    left = F.least(F.col("n") - F.col("run") * part_rows, F.lit(part_rows)).cast("int")
    spread = F.pmod(F.xxhash64(other, "run"), F.coalesce("_parts", F.lit(1)))
    event = F.struct(F.col(other).alias("other"), "rating")
    return (
        pairs.select(own, other, "rating", "n", run)
        .join(sizes, own, "left")
        .select(
            own,
            spread.cast("int").alias("part"),
            F.array_repeat(event, left).alias("copies"),
        )
        .groupBy(own, "part")
        .agg(F.array_sort(F.flatten(F.collect_list("copies"))).alias("events"))
    )
