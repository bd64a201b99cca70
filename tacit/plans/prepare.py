"""From raw feedback to indexed interactions and popularity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tacit.operators.filters import kcore
from tacit.operators.indexing import apply_index, dense_index
from tacit.operators.weights import item_popularity
from tacit.scratch import materialize


@dataclass(frozen=True)
class Prepared:
    """``interactions``: user_idx, item_idx, rating.  ``users``/``items``: raw id, idx."""

    interactions: DataFrame
    popularity: DataFrame
    users: DataFrame
    items: DataFrame


def prepare(
    df: DataFrame, user_col: str = "user_id", item_col: str = "business_id", k: int = 10
) -> Prepared:
    """k-core, dense ids by frequency, popularity over all remaining rows, constant rating.

    The core and the indexed interactions are stored once each, since everything downstream
    reads them several times.
    """
    core = materialize(kcore(df.select(user_col, item_col), user_col, item_col, k), "core")
    users = dense_index(core, user_col)
    items = dense_index(core, item_col)
    indexed = apply_index(core, users, items, user_col, item_col)
    interactions = materialize(
        indexed.withColumn("rating", F.lit(1.0).cast("float")), "interactions"
    )
    return Prepared(interactions, item_popularity(interactions), users, items)
