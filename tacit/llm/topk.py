"""Exact top-k inner products of a query set against all vectors.

Queries and vectors are cut into blocks of bounded size.  Every pair of a query block and a shard
is one tile: a matrix product in one task, of which each query keeps its k best.  The lists of a
query are merged in a tree of bounded fan-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tacit.scratch import materialize, store

QUERY_ROWS = 16_384
SHARD_ROWS = 16_384
FAN_IN = 16
# Queries of a block that are multiplied at a time.
STEP = 128
# Integers up to here are exact in double precision; scores from LONG on do not fit a long.
EXACT = 2**53
LONG = 2**63
# No score: the lowest long, which the range of scores leaves out.
NOTHING = -LONG


def codes(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null for vectors that take no part.

    Those are null, empty, or hold a null or a component that is not finite.  A code that does
    not fit a long ends the job.
    """
    wide = vector.cast("array<double>")
    # Not a number compares as greater than all numbers.
    good = F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))

    def code(x: Column) -> Column:
        scaled = x * F.lit(float(scale))
        fits = F.abs(scaled) < F.lit(float(LONG))
        return F.when(fits, F.floor(scaled)).otherwise(
            F.raise_error(F.lit("a code does not fit a long")).cast("long")
        )

    return F.when(good & (F.size(wide) > 0), F.transform(wide, lambda x: code(x)))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    query_rows: int = QUERY_ROWS,
    shard_rows: int = SHARD_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest inner products.

    Both tables hold ``vec_id`` and ``code``, an array of longs.  Ties go to the smaller vec_id.
    Rows without id or code take no part, and vectors of another length than the query's are no
    candidates; nor are rows with the query's own id.  Repeated rows of a vector are candidates
    each; a repeated query row is answered once.  Where a query id has several vectors all are
    asked, and its answer is the ``k`` best of all their scores, a candidate once per vector.
    Scores are exact; one outside of +-(2**63 - 1) ends the job, as it does not fit a long.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if min(query_rows, shard_rows) < 1 or fan_in < 2:
        raise ValueError("blocks hold a row at least, and merges two lists")
    usable = F.col("vec_id").isNotNull() & F.col("code").isNotNull()
    row = (F.col("vec_id").cast("long").alias("vec_id"), F.col("code").cast("array<bigint>").alias("code"))
    # Of equal rows only k can be among the k best, so that many copies never fill a shard.
    counted = vectors.where(usable).select(*row).groupBy("vec_id", "code").agg(
        F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    base = store(counted.select("vec_id", "code", _size(), copies.alias("copy")), "vectors")
    asked = store(
        queries.where(usable).select(*row).dropDuplicates().select("*", _size()), "queries"
    )
    # Blocks by a hash of the whole row: about the wanted number of rows in each, also where one
    # id or one vector has a large part of them.  Tiles hold vectors of one length.
    shards = max(1, -(-base.rows // shard_rows))
    blocks = max(1, -(-asked.rows // query_rows))
    left = _narrow(asked.frame).select(
        "vec_id",
        "code",
        "size",
        F.pmod(F.xxhash64("vec_id", "code"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    right = _narrow(base.frame).select(
        "vec_id",
        "code",
        "size",
        F.pmod(F.xxhash64("code", "vec_id", "copy"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    best = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("tile", T.LongType()),
            T.StructField(
                "best",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("score", T.LongType()), T.StructField("other", T.LongType())]
                    )
                ),
            ),
        ]
    )

    def tile(key, asked_rows, vector_rows):
        _, shard, block = (part.as_py() for part in key)
        return _tile(block * shards + shard, asked_rows, vector_rows, k)

    keys = ("size", "shard", "block")
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, best)
    lists = materialize(tiles, "tile-lists")
    # A query's tiles lie side by side, so its lists meet in the first merges.
    left_over = blocks * shards
    while True:
        # Highest score first, then the smallest id, which ``other`` holds inverted.
        together = F.sort_array(F.flatten(F.collect_list("best")), asc=False)
        left_over = -(-left_over // fan_in)
        lists = lists.groupBy("query_id", F.expr(f"tile div {fan_in}").alias("tile")).agg(
            F.slice(together, 1, k).alias("best")
        )
        if left_over == 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.bitwise_not("hit.other").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )


def _size() -> Column:
    return F.size("code").alias("size")


def _narrow(rows: DataFrame) -> DataFrame:
    """Codes as ints where all of a table fit, which halves what the tiles copy."""
    high = F.array_max(F.transform("code", lambda x: F.greatest(x, F.bitwise_not(x))))
    most = rows.agg(F.max(high)).first()[0]
    fits = most is None or most < 2**31
    return rows.withColumn("code", F.col("code").cast("array<int>")) if fits else rows


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    codes_ = table.column("code").combine_chunks().flatten().to_numpy()
    return ids, codes_.astype(np.int64, copy=False).reshape(len(ids), -1)


def _most(codes_: np.ndarray) -> int:
    """The largest absolute value; the lowest long has none in its own type."""
    return max(int(codes_.max()), -int(codes_.min()))


def _wide_product(q: np.ndarray, v: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Exact products as longs, for codes whose products pass what doubles hold.

    Long arithmetic is exact modulo 2**64, so only the range is in question: ``near`` are the
    products in doubles, and where their error leaves it open, whole numbers decide.
    """
    product = q @ v
    error = 2.0**-52 * (len(v) + 4) * (len(v) * float(_most(q)) * float(_most(v)))
    for row, column in np.argwhere(~(np.abs(near) + error < LONG)):
        if near[row, column] == -np.inf:
            continue
        exact = sum(int(a) * int(b) for a, b in zip(q[row], v[:, column]))
        if abs(exact) >= LONG:
            raise OverflowError("a score does not fit a long")
    return product


def _tile(tile: int, asked: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The product of a query block and a shard, and the ``k`` best of each query in it."""
    empty = pa.schema(
        [
            ("query_id", pa.int64()),
            ("tile", pa.int64()),
            ("best", pa.list_(pa.struct([("score", pa.int64()), ("other", pa.int64())]))),
        ]
    )
    if not asked.num_rows or not vectors.num_rows:
        return empty.empty_table()
    query_ids, q = _matrix(asked)
    vec_ids, v = _matrix(vectors)
    # By ascending id, so that a stable selection prefers smaller ids among equals.
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, v = vec_ids[order], np.ascontiguousarray(v[order].T)
    exact = len(v) * _most(q) * _most(v) < EXACT
    shown = v.astype(float)
    scores, others, sizes = [], [], []
    for low in range(0, len(query_ids), STEP):
        ids = query_ids[low : low + STEP]
        some = q[low : low + STEP]
        product = some.astype(float) @ shown
        own = list(zip(np.searchsorted(vec_ids, ids, "left"), np.searchsorted(vec_ids, ids, "right")))
        none = -np.inf
        for row, (a, b) in zip(product, own):
            row[a:b] = none
        if not exact:
            product, none = _wide_product(some, v, product), NOTHING
            for row, (a, b) in zip(product, own):
                row[a:b] = none
        if len(vec_ids) > k:
            least = np.partition(product, len(vec_ids) - k, axis=1)[:, len(vec_ids) - k]
        else:
            least = np.full(len(ids), none)
        for row, bound in zip(product, least):
            found = np.flatnonzero((row >= bound) & (row > none))
            found = found[np.argsort(-row[found], kind="stable")[:k]]
            scores.append(row[found].astype(np.int64))
            others.append(~vec_ids[found])
            sizes.append(len(found))
    hits = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(scores)), pa.array(np.concatenate(others))], ["score", "other"]
    )
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(starts), hits)
    tiles = pa.array(np.full(len(query_ids), tile))
    return pa.Table.from_arrays([pa.array(query_ids), tiles, lists], schema=empty)
