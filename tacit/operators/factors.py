"""Factor tables: initial vectors and their Gram matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tacit.functions.draws import DRAWS_PER_DIGEST, digest, normal_from, uniform_from
from tacit.scratch import spread

# Upper end of the uniform start and deviation of the normal start.
UNIFORM_SCALE = 0.01
NORMAL_SCALE = 0.1


def start_vector(col: str, k: int, distribution: str, seed: int, storage: str) -> Column:
    """The start vector of the id in column ``col``: draws on (side, id, group of positions)."""

    if distribution == "uniform":
        made, scale, per_digest = uniform_from, UNIFORM_SCALE, DRAWS_PER_DIGEST
    elif distribution == "normal":
        made, scale, per_digest = normal_from, NORMAL_SCALE, DRAWS_PER_DIGEST // 2
    else:
        raise ValueError(f"unknown distribution {distribution!r}")

    # One digest gives several elements; the inner transform names it, so it is made once.
    def run(g: Column) -> Column:
        one = F.array(digest(col, F.col(col), g, seed=seed))
        return F.transform(
            one, lambda d: F.array(*[(made(d, at) * F.lit(scale)).cast(storage) for at in range(per_digest)])
        )[0]

    groups = F.sequence(F.lit(0), F.lit((k - 1) // per_digest))
    return F.slice(F.flatten(F.transform(groups, run)), 1, k)


def init_factors(
    entities: DataFrame,
    col: str,
    k: int,
    distribution: str = "uniform",
    seed: int = 42,
    storage: str = "float",
) -> DataFrame:
    """``(col, factors)``: one start vector per distinct value of ``col``.

    "uniform" draws elements from U[0, 0.01), "normal" from N(0, 0.1).
    """
    vector = start_vector(col, k, distribution, seed, storage)
    return spread(entities.select(col).distinct(), col).select(col, vector.alias("factors"))


def complete_factors(
    entities: DataFrame,
    factors: DataFrame,
    col: str,
    k: int,
    distribution: str = "normal",
    seed: int = 42,
    storage: str = "float",
) -> DataFrame:
    """``factors`` for every value of ``col`` in ``entities``; unknown ids get a start vector.

    The vector of an unknown id is a function of the id, hence the same wherever it is used.
    """
    vector = start_vector(col, k, distribution, seed, storage)
    known = factors.select(col, F.col("factors").alias("_known"))
    return (
        spread(entities.select(col).distinct(), col)
        .join(known, col, "left")
        .select(col, F.coalesce("_known", vector).alias("factors"))
    )


def complete_confidence(entities: DataFrame, confidence: DataFrame) -> DataFrame:
    """Confidence of every item in ``entities``; items without one get zero."""
    return (
        entities.select("item_idx")
        .distinct()
        .join(confidence.select("item_idx", "c_i"), "item_idx", "left")
        .select("item_idx", F.coalesce("c_i", F.lit(0.0)).alias("c_i"))
    )


def matrix_of(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a 2-D array, without a copy where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1 if width is None and len(column) else (width or 0))


def gram(factors: DataFrame, weight_col: str | None = None) -> DataFrame:
    """``(f, g, value)``: the sum over rows of weight * x_f * x_g."""
    half = _half_gram(factors, weight_col)
    cell = F.struct("f", "g")
    mirror = F.struct(F.col("g").alias("f"), F.col("f").alias("g"))
    cells = F.when(F.col("f") == F.col("g"), F.array(cell)).otherwise(F.array(cell, mirror))
    return half.select(F.explode(cells).alias("at"), "value").select("at.f", "at.g", "value")


def _half_gram(factors: DataFrame, weight_col: str | None = None) -> DataFrame:
    """The cells of :func:`gram` with f <= g.

    Each task adds up its own matrix, so only one triangle per task is shuffled.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("factors")).astype(np.float64, copy=False)
            left = x
            if weight_col is not None:
                left = x * batch.column(weight_col).to_numpy()[:, None]
            part = left.T @ x
            total = part if total is None else total + part
        if total is not None:
            f, g = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(f.astype(np.int32)),
                    pa.array(g.astype(np.int32)),
                    pa.array(total[f, g]),
                ],
                names=["f", "g", "value"],
            )

    columns = ["factors"] if weight_col is None else ["factors", weight_col]
    parts = factors.select(*columns).mapInArrow(partial, "f int, g int, value double")
    return parts.groupBy("f", "g").agg(F.sum("value").alias("value"))


def weighted_items(items: DataFrame, confidence: DataFrame) -> DataFrame:
    """Item factors with their confidence; items without one drop out."""
    return items.join(confidence.select("item_idx", "c_i"), "item_idx")


def cache_matrix(factors: DataFrame, weight_col: str | None, k: int) -> np.ndarray:
    """The Gram matrix as K x K values on the driver, to travel with the update's tasks."""
    out = np.zeros((k, k))
    for row in _half_gram(factors, weight_col).collect():
        out[row.f, row.g] = out[row.g, row.f] = row.value
    return out
