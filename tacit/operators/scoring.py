"""Inner products of pairs, and ranks of true items, without a vector per pair in any shuffle.

Small factor tables are broadcast.  Otherwise pairs are dealt to cells: chunks of them by their
user, blocks of items by size.  A user's vector travels once to each cell that has a pair of it,
an item's once to each chunk, and a cell computes all its products with NumPy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tacit.functions import dot
from tacit.scratch import store

# Largest table that scoring broadcasts: eight bytes an element, and what a row takes besides.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 32
# Item vectors of a block, in bytes and rows, and pairs of a cell in the mean.
BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 1 << 21
CELL_PAIRS = 1 << 20
# A cell takes this many pairs per item vector it is sent, up to a most.
PAIRS_PER_VECTOR, MOST_PAIRS = 16, 1 << 23
# Pairs whose products a cell computes at a time.
SLICE_PAIRS = 1 << 16


def table_sizes(users: DataFrame, items: DataFrame) -> tuple[int, int, int]:
    """Rows of both tables and the length of their vectors."""
    sizes = None
    for at, table in enumerate((users, items)):
        size = table.agg(
            F.lit(at).alias("at"),
            F.count(F.lit(1)).alias("rows"),
            F.max(F.size("factors")).alias("width"),
        )
        sizes = size if sizes is None else sizes.unionByName(size)
    first, second = sorted(sizes.collect(), key=lambda row: row.at)
    return first.rows, second.rows, max(first.width or 0, second.width or 0)


def fits_broadcast(rows: int, width: int, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the driver may hold a table; short rows cost it more than their elements."""
    return rows * (8 * width + ROW_BYTES) <= broadcast_bytes


def score_pairs(
    pairs: DataFrame,
    users: DataFrame,
    items: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``score`` = inner product; pairs without both vectors drop out.

    A NaN score is an error: it would sort before every number and look like a perfect rank.
    Where only one table is small it is broadcast and the other one merged, a vector a user (or
    item); where none is, pairs meet their vectors in cells.
    """
    n_users, n_items, width = sizes = table_sizes(users, items)
    small = [fits_broadcast(rows, width, broadcast_bytes) for rows in (n_users, n_items)]
    if not any(small):
        return _scored_in_cells(pairs, users, items, sizes, block_bytes)
    tables = [
        items.select("item_idx", F.col("factors").alias("_q")),
        # Users last: the scores are then already placed for a ranking within users.
        users.select("user_idx", F.col("factors").alias("_p")),
    ]
    joined = pairs
    for table, fits in zip(tables, small[::-1]):
        # Generated pairs look small to the planner, so the sides are chosen here.
        joined = joined.join(F.broadcast(table) if fits else table.hint("merge"), table.columns[0])
    scored = joined.select(*pairs.columns, dot(F.col("_p"), F.col("_q"), width).alias("score"))
    checked = F.when(F.isnan("score"), F.raise_error(F.lit("score is NaN"))).otherwise(F.col("score"))
    return scored.select(*pairs.columns, checked.cast("double").alias("score"))


class Vectors:
    """The vectors of a cell by id."""

    def __init__(self, table: pa.Table, side: int):
        own = np.flatnonzero(table.column("_side").to_numpy() == side)
        ids = table.column("_id").to_numpy()[own]
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        rows = table.column("_vector").combine_chunks().take(pa.array(own[order]))
        # A row per element, so that one element of many vectors is one gather.  Elements stay as
        # they are stored; products are made of doubles.
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        width = len(flat) // max(1, len(self.ids))
        self.elements = np.ascontiguousarray(flat.reshape(len(self.ids), width).T)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids, and which of them are there."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids


def products(users: Vectors, items: Vectors, u: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Inner products of the vectors at places u and i, summed in the order of elements."""
    made = np.zeros(len(u))
    for low in range(0, len(u), SLICE_PAIRS):
        a, b = u[low : low + SLICE_PAIRS], i[low : low + SLICE_PAIRS]
        for p, q in zip(users.elements, items.elements):
            made[low : low + SLICE_PAIRS] += p[a].astype(np.float64, copy=False) * q[b]
    if np.isnan(made).any():
        raise ValueError("score is NaN")
    return made


def element_bytes(users: DataFrame, items: DataFrame) -> int:
    """Bytes of a vector element as it travels."""
    kinds = {dict(table.dtypes)["factors"] for table in (users, items)}
    return 4 if kinds == {"array<float>"} else 8


def _vectors(table: DataFrame, side: int, kind: str) -> DataFrame:
    id_col = table.columns[0]
    return table.select(
        F.col("_chunk").alias("_of_chunk"),
        F.col("_block").alias("_of_block"),
        F.lit(side).alias("_side"),
        F.col(id_col).cast("long").alias("_id"),
        F.col("factors").cast(kind).alias("_vector"),
    )


def _in_cells(
    placed: DataFrame,
    routes: DataFrame,
    users: DataFrame,
    items: DataFrame,
    chunks: int,
    blocks: int,
    work: Callable,
    schema,
    crowded: DataFrame | None = None,
) -> DataFrame:
    """Run ``work(pairs, users, items)`` per cell of ``placed``, which has ``_chunk`` and ``_block``.

    ``routes``: the ``(_chunk, _block, user_idx)`` of its rows, which may repeat.  ``crowded``: the
    ``(_block, _parts)`` of blocks with chunks of their own number.  Vectors travel with the
    elements they are stored with; products are made of doubles.
    """
    # One shuffle by user finds the cells and meets the vectors.
    cells = routes.groupBy("user_idx").agg(F.collect_set(F.struct("_chunk", "_block")).alias("_cells"))
    sent = cells.join(users.select("user_idx", "factors"), "user_idx")
    sent = sent.select("user_idx", "factors", F.explode("_cells").alias("_at"))
    kind = "array<float>" if element_bytes(users, items) == 4 else "array<double>"
    user_vectors = _vectors(sent.select("user_idx", "factors", "_at._chunk", "_at._block"), 0, kind)
    block = F.pmod(F.col("item_idx"), F.lit(blocks)).cast("int").alias("_block")
    dealt, parts = items.select("item_idx", "factors", block), F.lit(chunks)
    if crowded is not None:
        dealt = dealt.join(F.broadcast(crowded), "_block", "left")
        parts = F.coalesce("_parts", F.lit(chunks))
    dealt = dealt.select(
        "item_idx", "factors", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("_chunk"), "_block"
    )
    vectors = user_vectors.unionByName(_vectors(dealt, 1, kind))

    def cell(pairs: pa.Table, known: pa.Table) -> pa.Table:
        return work(pairs, Vectors(known, 0), Vectors(known, 1))

    facing = vectors.groupBy("_of_chunk", "_of_block")
    return placed.groupBy("_chunk", "_block").cogroup(facing).applyInArrow(cell, schema)


def _grid(
    spark, n_pairs: int, n_users: int, n_items: int, width: int, block_bytes: int, element: int = 8
) -> tuple[int, int]:
    """Chunks and blocks of the cells for ``n_pairs`` pairs.

    A user's vector goes to about every block and an item's to every chunk, so with as many
    cells as the work needs the sides are chosen to send few vectors.  Cells of large blocks take
    more pairs, else the vectors sent would grow faster than the pairs.  A cell gets the vectors
    of its own pairs' users only, so small blocks need no further chunks.
    """
    size = width * element
    least = max(1, -(-n_items * size // block_bytes), -(-n_items // BLOCK_ROWS))
    cell_pairs = max(CELL_PAIRS, min(MOST_PAIRS, PAIRS_PER_VECTOR * (n_items // least)))
    cells = max(2 * spark.sparkContext.defaultParallelism, -(-n_pairs // cell_pairs))
    even = round((cells * n_items / max(1, n_users)) ** 0.5)
    blocks = max(least, min(cells, even))
    met = min(n_users, -(-n_pairs // blocks))
    fitting = max(-(-met * size // (2 * BLOCK_BYTES)), -(-met // (2 * BLOCK_ROWS)))
    return max(1, -(-cells // blocks), fitting), blocks


def _scored_in_cells(
    pairs: DataFrame, users: DataFrame, items: DataFrame, sizes: tuple[int, int, int], block_bytes: int
) -> DataFrame:
    numbered = store(pairs.withColumn("_row", F.monotonically_increasing_id()), "pairs-to-score")
    chunks, blocks = _grid(pairs.sparkSession, numbered.rows, *sizes, block_bytes, element_bytes(users, items))
    rows, salt = numbered.frame, F.lit(0)
    block = F.pmod(F.col("item_idx"), F.lit(blocks)).cast("int").alias("_block")
    crowded, parts = None, F.lit(chunks)
    if numbered.rows > CELL_PAIRS:
        # A user with more pairs than a cell takes is spread; there are few such users.
        heavy = store(
            rows.groupBy("user_idx")
            .agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > CELL_PAIRS)
            .select("user_idx", F.ceil(F.col("_n") / CELL_PAIRS).alias("_parts")),
            "heavy",
        )
        if heavy.rows:
            rows = rows.join(F.broadcast(heavy.frame), "user_idx", "left")
            rows = rows.withColumnRenamed("_parts", "_user_parts")
            salt = F.pmod(F.xxhash64("_row"), F.coalesce("_user_parts", F.lit(1)))
        # A popular item's block gets chunks of its own number, a row per block at most.
        most = 2 * max(CELL_PAIRS, numbered.rows // (chunks * blocks))
        full = store(
            numbered.frame.groupBy(block)
            .agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > most * chunks)
            .select("_block", F.ceil(F.col("_n") / most).cast("int").alias("_parts")),
            "crowded",
        )
        if full.rows:
            crowded, parts = full.frame, F.coalesce("_parts", F.lit(chunks))
    placed = rows.withColumn("_block", block)
    if crowded is not None:
        placed = placed.join(F.broadcast(crowded), "_block", "left")
    placed = placed.select(
        *pairs.columns, F.pmod(F.xxhash64("user_idx", salt), parts).cast("int").alias("_chunk"), "_block"
    )
    names = pairs.columns

    def work(table: pa.Table, p: Vectors, q: Vectors) -> pa.Table:
        u, known = p.find(table.column("user_idx").to_numpy())
        i, there = q.find(table.column("item_idx").to_numpy())
        kept = known & there
        made = table.select(names).filter(pa.array(kept))
        return made.append_column("score", pa.array(products(p, q, u[kept], i[kept])))

    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())])
    routes = placed.select("_chunk", "_block", "user_idx")
    return _in_cells(placed, routes, users, items, chunks, blocks, work, schema, crowded)


def true_scores(
    cases: DataFrame,
    users: DataFrame,
    items: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(user_idx, true_item, _true)``: cases whose true item has a score, with it."""
    pairs = cases.select("user_idx", F.col("true_item").cast("int").alias("item_idx"), "true_item")
    return score_pairs(pairs, users, items, broadcast_bytes, block_bytes).select(
        "user_idx", "true_item", F.col("score").alias("_true")
    )


def rank_lists(
    cases: DataFrame,
    lists: DataFrame,
    users: DataFrame,
    items: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(user_idx, item_idx, rank, n_candidates)`` per case whose true item has a score.

    ``cases``: distinct ``(user_idx, true_item)``; ``lists``: their negatives, as
    :func:`~tacit.operators.negative_lists` gives them.  The true score of a case is computed
    first and travels with its lists; a cell scores them and returns two counts a case, so no
    score leaves it.  Equal scores rank by item, then the true row; negatives without a vector
    do not count.
    """
    truth = true_scores(cases, users, items, broadcast_bytes, block_bytes)
    # Drawn lists look as small as their cases to the planner, which would broadcast them.
    posed = store(lists.join(truth.hint("merge"), ["user_idx", "true_item"]), "lists").frame
    n_pairs = posed.agg(F.sum(F.size("negatives"))).first()[0] or 0
    return rank_posed(posed, n_pairs, users, items, block_bytes)


def rank_posed(
    posed: DataFrame,
    n_pairs: int,
    users: DataFrame,
    items: DataFrame,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ranks of :func:`rank_lists` from lists that hold their true score.

    ``posed``: ``(user_idx, true_item, negatives, _true)``, stored.
    """
    spark = posed.sparkSession
    _, n_items, width = table_sizes(users, items)
    blocks = max(1, -(-n_items * width * 8 // block_bytes), -(-n_items // BLOCK_ROWS))
    cell_pairs = max(CELL_PAIRS, min(MOST_PAIRS, PAIRS_PER_VECTOR * (n_items // blocks)))
    slots = 2 * spark.sparkContext.defaultParallelism
    chunks = max(1, -(-slots // blocks), -(-n_pairs // (cell_pairs * blocks)))
    # Cases of one user may go to several chunks, so no user is too much for one.
    chunk = F.pmod(F.xxhash64("user_idx", "true_item"), F.lit(chunks)).cast("int")
    at = F.col("true_item").cast("long")
    placed = posed.select(
        "user_idx", "true_item", "negatives", "_true", at.alias("_place"), chunk.alias("_chunk")
    )
    if blocks == 1:
        placed = placed.withColumn("_block", F.lit(0))
    else:

        def block_of(item: Column) -> Column:
            return F.pmod(item, F.lit(blocks)).cast("int")

        present = F.array_distinct(F.transform("negatives", block_of))
        placed = placed.withColumn("_block", F.explode_outer(present)).select(
            "user_idx",
            "true_item",
            F.filter("negatives", lambda item: block_of(item) == F.col("_block")).alias("negatives"),
            "_true",
            "_place",
            "_chunk",
            F.coalesce("_block", F.lit(0)).alias("_block"),
        )
        placed = store(placed, "lists-in-cells").frame
    routes = placed.select("_chunk", "_block", "user_idx")

    def work(table: pa.Table, p: Vectors, q: Vectors) -> pa.Table:
        user, place, bounds = (table.column(name).to_numpy() for name in ("user_idx", "_place", "_true"))
        negatives = table.column("negatives").combine_chunks()
        starts, listed = negatives.offsets.to_numpy(), negatives.values.to_numpy()
        places, _ = p.find(user)
        before, n = np.zeros(len(user), np.int64), np.zeros(len(user), np.int64)
        low = 0
        while low < len(user):
            # As many cases as a slice takes, and one at least.
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + SLICE_PAIRS, "right")) - 1)
            case = np.repeat(np.arange(low, high), np.diff(starts[low : high + 1]))
            item = listed[starts[low] : starts[high]]
            i, kept = q.find(item)
            case, item, i = case[kept], item[kept], i[kept]
            scores = products(p, q, places[case], i)
            bound = bounds[case]
            first = (scores > bound) | ((scores == bound) & (item < place[case]))
            before[low:high] = np.bincount(case[first] - low, minlength=high - low)
            n[low:high] = np.bincount(case - low, minlength=high - low)
            low = high
        return pa.table(
            {
                "user_idx": table.column("user_idx"),
                "true_item": table.column("true_item"),
                "before": before,
                "n": n,
            }
        )

    kinds = {name: kind for name, kind in posed.dtypes}
    schema = f"user_idx {kinds['user_idx']}, true_item {kinds['true_item']}, before long, n long"
    counts = _in_cells(placed, routes, users, items, chunks, blocks, work, schema)
    return (
        counts.groupBy("user_idx", "true_item")
        .agg((F.sum("before") + 1).alias("rank"), F.sum("n").alias("n_candidates"))
        .select("user_idx", F.col("true_item").alias("item_idx"), "rank", "n_candidates")
    )
