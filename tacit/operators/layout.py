"""Placement of interactions for the factor updates.

One side of a fit (say users) is cut into blocks of bounded size.  A block keeps the packed
histories of its users, and a routing table says which blocks need which item, so an update
ships each item vector once per block instead of once per interaction: a very popular item
costs one message per block however many rows it has.

A user with more pairs than ``chunk_pairs`` is split over several blocks by a hash of the
counterpart; each chunk then yields partial normal equations that are added up afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tacit.scratch import Stored, store, task_width

# Fixed value: bytes of counterpart vectors that a block may pull into one task.
BLOCK_BYTES = 1 << 25
# More blocks than task slots, so that hashing spreads them evenly.
BLOCKS_PER_SLOT = 4
# Partitions of a layout stay below this unless the session's own shuffle width is larger.
MAX_WIDTH = 1 << 15
# Split entities up to this number are broadcast to tag their rows; beyond it they are joined.
BROADCAST_SPLITS = 1_000_000
# Block numbers per routing row: one bit of a long each.
ROUTE_SPAN = 64


def pair_table(interactions: DataFrame, on_duplicate: str = "keep") -> DataFrame:
    """``(user_idx, item_idx, n, w, wr)``: distinct pairs with their copies added up.

    A bag of copies enters the normal equations only through its row count ``n``, the sum of
    weights ``w`` and the sum of weight times rating ``wr``.  The aggregate is combined on the
    map side, so a pair with very many copies shrinks before the shuffle.  The optional input
    column ``weight`` defaults to 1; ``on_duplicate="distinct"`` counts a pair once.
    """
    rating = F.col("rating").cast("double") if "rating" in interactions.columns else F.lit(1.0)
    weight = F.col("weight").cast("double") if "weight" in interactions.columns else F.lit(1.0)
    pairs = interactions.groupBy("user_idx", "item_idx")
    if on_duplicate == "keep":
        return pairs.agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(weight).alias("w"),
            F.sum(weight * rating).alias("wr"),
        )
    if on_duplicate == "distinct":
        return pairs.agg(
            F.lit(1.0).alias("n"),
            F.max(weight).alias("w"),
            F.max(weight * rating).alias("wr"),
        )
    raise ValueError(f"unknown on_duplicate {on_duplicate!r}")


def with_confidence(pairs: DataFrame, confidence: DataFrame | float) -> DataFrame:
    """Attach ``c_i`` to every pair; pairs of an item without confidence drop out.

    A number stands for the same confidence of every item.
    """
    if isinstance(confidence, DataFrame):
        return pairs.join(confidence.select("item_idx", "c_i"), "item_idx")
    return pairs.withColumn("c_i", F.lit(float(confidence)))


@dataclass(frozen=True)
class Layout:
    """``histories``: block, own, split, c, others, n, w, wr.  ``routes``: other, span, mask.

    Bit b of a route's mask stands for block ``ROUTE_SPAN * span + b``.

    Lists are binary, see :func:`to_bytes`.  Those of n, w and wr are empty where all three are one
    for every pair of the row, which is the plain implicit case; a pair then costs the four bytes
    of its counterpart.
    """

    own: str
    other: str
    other_kind: str
    n_blocks: int
    has_split: bool
    histories: DataFrame
    routes: DataFrame
    large: Stored | None

    def home(self, own: Column) -> Column:
        """Block of an entity that is not split."""
        return F.pmod(F.xxhash64(own), F.lit(self.n_blocks)).cast("int")

    def release(self) -> None:
        self.histories.unpersist()
        self.routes.unpersist()
        if self.large is not None:
            self.large.drop()


def default_block_pairs(k: int, storage: str = "float") -> int:
    return max(1 << 14, BLOCK_BYTES // ({"float": 4, "double": 8}[storage] * k))


def to_bytes(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose row r holds ``values[ends[r]:ends[r + 1]]``.

    Spark copies a binary value at once, the elements of an array one by one.
    """
    bounds = (ends * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def from_bytes(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of :func:`to_bytes`."""
    values = column.combine_chunks().cast(pa.large_binary())
    _, bounds, data = values.buffers()
    at = np.frombuffer(bounds, np.int64)[values.offset : values.offset + len(values) + 1]
    kind = np.dtype(kind)
    if at[0] == at[-1]:
        return np.zeros(len(values), np.int64), np.empty(0, kind)
    return np.diff(at) // kind.itemsize, np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)


def pack_histories(own_col: str, other_col: str, kind: str) -> Callable[[pa.Table], pa.Table]:
    """The function that packs the pairs of one block into a row per entity or chunk."""

    def pack(pairs: pa.Table) -> pa.Table:
        pairs = pairs.combine_chunks()
        names, count = pairs.column_names, pairs.num_rows
        own = pairs.column(own_col)
        if own.null_count:
            own = pc.fill_null(own.cast(pa.int64()), -(1 << 63))
        own = own.to_numpy()
        c = pairs.column("c") if "c" in names else pa.nulls(count, pa.float64())
        chunk = pairs.column("chunk") if "chunk" in names else pa.nulls(count, pa.int64())
        order = np.argsort(own, kind="stable")

        def borders(*keys: np.ndarray) -> np.ndarray:
            new = np.zeros(count, bool)
            new[:1] = True
            for key in keys:
                new[1:] |= key[order[1:]] != key[order[:-1]]
            return new

        new = borders(own)
        weight = pc.fill_null(c, np.inf).to_numpy() if "c" in names else np.zeros(count)
        if "chunk" in names or ("c" in names and not np.array_equal(new, borders(own, weight))):
            part = pc.fill_null(chunk, -1).to_numpy()
            order = np.lexsort((weight, part, own))
            new = borders(own, part, weight)
        starts = np.flatnonzero(new)
        ends = np.append(starts, count)
        lengths = np.diff(ends)

        # Empty stands for ones, see Layout.
        numbers = {name: pairs.column(name) for name in ("n", "w", "wr")}
        given = np.zeros(count, bool)
        for column in numbers.values():
            given |= pc.fill_null(pc.not_equal(column, 1.0), False).to_numpy()
        used = np.logical_or.reduceat(given[order], starts)
        kept = order[np.repeat(used, lengths)]
        bounds = np.append(0, np.cumsum(np.where(used, lengths, 0)))

        firsts = pa.array(order[starts])
        others = pairs.column(other_col).cast(kind)
        if others.null_count:
            others = pc.fill_null(others, int(np.iinfo(kind).min))
        columns = {
            "block": pairs.column("block").take(firsts),
            own_col: pairs.column(own_col).take(firsts),
            "split": pc.is_valid(chunk.take(firsts)),
            "c": c.take(firsts),
            "others": to_bytes(ends, others.to_numpy()[order]),
        }
        for name, column in numbers.items():
            columns[name] = to_bytes(bounds, column.to_numpy()[kept])
        return pa.table(columns)

    return pack


def build_layout(
    pairs: DataFrame,
    n_pairs: int,
    side: str,
    block_pairs: int,
    chunk_pairs: int | None = None,
) -> Layout:
    """Place ``pairs`` (a stored table with ``c_i``) for updates of ``side``: "user" or "item".

    Both tables of the layout are kept for the whole fit, partitioned and sorted as the updates
    read them; a lost executor's share is rebuilt from the stored pairs.
    """
    own, other = ("user_idx", "item_idx") if side == "user" else ("item_idx", "user_idx")
    spark = pairs.sparkSession
    slots = spark.sparkContext.defaultParallelism
    n_blocks = max(math.ceil(n_pairs / block_pairs), BLOCKS_PER_SLOT * slots)
    wanted = min(n_blocks // BLOCKS_PER_SLOT, MAX_WIDTH)
    width = min(n_blocks, max(task_width(spark), wanted))
    chunk_pairs = chunk_pairs or max(1, block_pairs // 4)

    chunk = F.lit(None).cast("bigint")
    placed, n_large, large = pairs, 0, None
    if n_pairs > chunk_pairs:
        large = store(
            pairs.groupBy(own)
            .agg(F.count(F.lit(1)).alias("_size"))
            .where(F.col("_size") > chunk_pairs)
            .select(own, F.ceil(F.col("_size") / F.lit(chunk_pairs)).alias("_chunks")),
            "large",
        )
        n_large = large.rows
        if n_large:
            tag = F.broadcast(large.frame) if n_large <= BROADCAST_SPLITS else large.frame
            placed = pairs.join(tag, own, "left")
            part = F.pmod(F.xxhash64(other), F.col("_chunks"))
            chunk = F.when(F.col("_chunks").isNotNull(), part)
    where = F.when(chunk.isNotNull(), F.xxhash64(F.col(own), chunk)).otherwise(F.xxhash64(own))
    block = F.pmod(where, F.lit(n_blocks)).cast("int").alias("block")
    columns = [block, own, other, "n", "w", "wr"]
    # On the item side the confidence belongs to the entity; on the user side it comes along
    # with the item vectors.
    columns += [F.col("c_i").alias("c")] if side == "item" else []
    columns += [chunk.alias("chunk")] if n_large else []
    placed = placed.select(*columns)

    # A group is a block, whose rows are packed with one sort; list aggregates would sort all rows
    # of a task by every key.  The second shuffle moves packed rows, a row per entity.
    kinds = dict(placed.dtypes)
    other_kind = "int32" if kinds[other] == "int" else "int64"
    packed = (
        f"block int, {own} {kinds[own]}, split boolean, c double, others binary, n binary, w binary, wr binary"
    )
    histories = (
        placed.repartition(width, "block")
        .groupBy("block")
        .applyInArrow(pack_histories(own, other, other_kind), packed)
        .repartition(width, "block")
        .sortWithinPartitions("block")
    )
    # Masks combine on the map side, so a popular counterpart arrives as block sets.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("block") % ROUTE_SPAN)
    routes = (
        placed.groupBy(other, F.floor(F.col("block") / ROUTE_SPAN).cast("int").alias("span"))
        .agg(F.bit_or(bit).alias("mask"))
        .repartition(width, other)
    )
    return Layout(
        own,
        other,
        other_kind,
        n_blocks,
        bool(n_large),
        histories.persist(StorageLevel.MEMORY_AND_DISK),
        routes.persist(StorageLevel.MEMORY_AND_DISK),
        large,
    )
