"""One half-step of a fit: update every entity of one side from the other side's vectors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tacit.operators import kernels
from tacit.operators.factors import cache_matrix, matrix_of
from tacit.operators.layout import ROUTE_SPAN, Layout, from_bytes, to_bytes
from tacit.scratch import Stored, store

ARROW_TYPE = {"float": pa.float32(), "double": pa.float64()}
# Elements of vectors that one batch of messages may come to.
MESSAGE_ELEMENTS = 1 << 22


@dataclass(frozen=True)
class Update:
    """How to update: ``method`` "sweep" or "solve", ``start`` "warm" or "cold"."""

    k: int
    lam: float
    method: str = "sweep"
    start: str = "warm"
    storage: str = "float"


class State:
    """A fresh factor table, stored in one or two parts.

    Next to the vectors each part holds the Gram matrices of its task groups, so the next
    half-step gets its missing-data matrix without a second pass over the vectors.
    """

    def __init__(self, own: str, parts: list[Stored]):
        self.parts = parts
        tables = [part.frame.where(F.col(own).isNotNull()) for part in parts]
        if len(parts) > 1:
            tables[0] = tables[0].where(F.col("partial").isNull()).drop("partial")
        self.frame = reduce(DataFrame.unionByName, tables).drop("gram")

    def cache(self, k: int) -> np.ndarray:
        grams = [
            part.frame.where(F.col("gram").isNotNull()).select(F.posexplode("gram"))
            for part in self.parts
        ]
        cells = reduce(DataFrame.unionAll, grams).groupBy("pos").agg(F.sum("col").alias("value"))
        packed = np.zeros(kernels.triangle(k))
        for row in cells.collect():
            packed[row.pos] = row.value
        return kernels.symmetric(packed[None, :], k)[0]

    def drop(self) -> None:
        for part in self.parts:
            part.drop()


def step(
    layout: Layout,
    counterpart: DataFrame,
    own: DataFrame | None,
    how: Update,
    cache: np.ndarray | None = None,
) -> State:
    """New factors of ``layout.own`` as a stored table.

    ``counterpart`` and ``own`` hold id, factors and, for items, c_i.  ``own`` gives the start
    vectors of a warm sweep and may be None otherwise.  ``cache`` is the missing-data matrix of
    the counterpart where it is known already.  Entities without any observed counterpart do
    not appear in the result.
    """
    item_side = layout.own == "item_idx"
    if cache is None:
        # Weighted by c when the items are summed over, plain when the users are: an item's own
        # c then scales it.
        cache = cache_matrix(counterpart, None if item_side else "c_i", how.k)
    warm = own is not None and how.start == "warm" and how.method == "sweep"
    schema = f"{layout.own} int, factors array<{how.storage}>, gram array<double>"
    if item_side:
        schema += ", c_i double"
    own = own if warm else None
    kinds = message_kinds(layout, counterpart, own)
    parts = [
        store(
            layout.histories.groupBy("block")
            .cogroup(messages(layout, counterpart, own, kinds).groupBy("block"))
            .applyInArrow(
                block_update(layout, how, cache, warm, kinds),
                schema + (", partial array<double>" if layout.has_split else ""),
            ),
            f"{layout.own}-factors",
        )
    ]
    if layout.has_split:
        parts.append(
            store(
                finish_split(layout, parts[0].frame, own, how, cache, schema),
                f"{layout.own}-split",
            )
        )
    return State(layout.own, parts)


def factor_batch(
    own_col: str, ids: np.ndarray, c: np.ndarray | None, x: np.ndarray, value_type: pa.DataType
) -> dict[str, pa.Array]:
    """Columns for the updated entities and one more row with the Gram matrix of their vectors."""
    count, k = x.shape
    stored = x.astype(value_type.to_pandas_dtype(), copy=False)
    exact = stored.astype(np.float64, copy=False)
    gram = (exact.T if c is None else exact.T * c) @ exact
    offsets = np.append(np.arange(count + 1, dtype=np.int32) * k, np.int32(count * k))
    columns = {
        own_col: pa.concat_arrays([pa.array(ids.astype(np.int32)), pa.nulls(1, pa.int32())]),
        "factors": pa.ListArray.from_arrays(pa.array(offsets), pa.array(stored.ravel())),
        "gram": pa.concat_arrays(
            [
                pa.nulls(count, pa.list_(pa.float64())),
                pa.array([kernels.pack(gram)], pa.list_(pa.float64())),
            ]
        ),
    }
    if c is not None:
        columns["c_i"] = pa.concat_arrays(
            [pa.array(np.asarray(c, np.float64)), pa.nulls(1, pa.float64())]
        )
    return columns


def message_kinds(layout: Layout, counterpart: DataFrame, own: DataFrame | None) -> tuple[str, str]:
    """Types of the ids and vector elements that messages carry."""
    types = dict(layout.routes.dtypes)[layout.other], dict(counterpart.dtypes)["factors"]
    ids, vectors = {types[0]}, {types[1]}
    if own is not None:
        ids.add(dict(own.dtypes)[layout.own])
        vectors.add(dict(own.dtypes)["factors"])
    return "int32" if ids == {"int"} else "int64", "float32" if vectors == {"array<float>"} else "float64"


def messages(
    layout: Layout, counterpart: DataFrame, own: DataFrame | None, kinds: tuple[str, str]
) -> DataFrame:
    """Vectors addressed to blocks: ``(block, own, ids, factors, c)``, many vectors a row.

    Lists are binary, as in the layout.
    """
    c = F.col("c_i") if "c_i" in counterpart.columns else F.lit(None).cast("double")
    tables = [
        layout.routes.join(counterpart, layout.other).select(
            F.lit(False).alias("own"),
            F.col("span").alias("block"),
            "mask",
            F.col(layout.other).alias("id"),
            "factors",
            c.alias("c"),
        )
    ]
    if own is not None:
        tables.append(
            own.where(F.col(layout.own).isNotNull()).select(
                F.lit(True).alias("own"),
                layout.home(F.col(layout.own)).alias("block"),
                F.lit(None).cast("bigint").alias("mask"),
                F.col(layout.own).alias("id"),
                "factors",
                F.lit(None).cast("double").alias("c"),
            )
        )
    schema = "block int, own boolean, ids binary, factors binary, c binary"
    sent = [table.mapInArrow(address(kinds), schema) for table in tables]
    return reduce(DataFrame.unionAll, sent)


def address(kinds: tuple[str, str]):
    """The function that makes a row per block with the vectors of a batch that it needs."""

    def send(batches):
        for whole in batches:
            if not whole.num_rows:
                continue
            width = len(whole.column("factors").flatten()) // whole.num_rows
            step = max(1, MESSAGE_ELEMENTS // (ROUTE_SPAN * max(1, width)))
            for low in range(0, whole.num_rows, step):
                yield addressed(whole.slice(low, step), width)

    def addressed(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
        block, is_own = batch.column("block").to_numpy(), batch.column("own")[0].as_py()
        if is_own:
            row = np.arange(batch.num_rows)
        else:
            masks = batch.column("mask").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            row, bit = np.nonzero(np.unpackbits(masks, axis=1, bitorder="little"))
            block = block[row] * ROUTE_SPAN + bit
        order = np.argsort(block, kind="stable")
        block, row = block[order], row[order]
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(starts, len(block))
        vectors = matrix_of(batch.column("factors"), width).astype(kinds[1], copy=False)
        # Own rows have no c.
        c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        c_ends = np.zeros_like(ends) if is_own else ends
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array(block[starts].astype(np.int32)),
                "own": pa.array(np.full(len(starts), is_own)),
                "ids": to_bytes(ends, batch.column("id").to_numpy().astype(kinds[0])[row]),
                "factors": to_bytes(ends * width, vectors[row].ravel()),
                "c": to_bytes(c_ends, c[:0] if is_own else c[row]),
            }
        )

    return send


def numbers_of(column: pa.ChunkedArray, lengths: np.ndarray) -> np.ndarray:
    """One number per pair; an empty row stands for ones."""
    out = np.ones(lengths.sum())
    given, values = from_bytes(column, "float64")
    out[np.repeat(given > 0, lengths)] = values
    return out


def block_update(
    layout: Layout, how: Update, cache: np.ndarray, warm: bool, kinds: tuple[str, str]
):
    """The function that updates the entities of one block from the messages it received."""
    own_col, item_side = layout.own, layout.own == "item_idx"
    has_split, other_kind = layout.has_split, layout.other_kind
    k, lam, method = how.k, how.lam, how.method
    value_type = ARROW_TYPE[how.storage]

    def table(ids, c, x, partial_ids=(), partial_c=(), partials=()):
        columns = factor_batch(own_col, ids, c if item_side else None, x, value_type)
        made = pa.table(columns)
        if not has_split:
            return made
        extra = {
            own_col: pa.array(partial_ids, pa.int32()),
            "factors": pa.nulls(len(partial_ids), pa.list_(value_type)),
            "gram": pa.nulls(len(partial_ids), pa.list_(pa.float64())),
            "c_i": pa.array(partial_c, pa.float64()),
            "partial": pa.array(partials, pa.list_(pa.float64())),
        }
        empty = pa.nulls(made.num_rows, pa.list_(pa.float64()))
        made = made.append_column("partial", empty)
        return pa.concat_tables([made, pa.table({c: extra[c] for c in made.column_names})])

    def update(histories: pa.Table, received: pa.Table) -> pa.Table:
        if not histories.num_rows or not received.num_rows:
            return table(np.empty(0, np.int32), np.empty(0), np.empty((0, k)))
        counts, ids = from_bytes(received.column("ids"), kinds[0])
        is_own = np.repeat(received.column("own").to_numpy(), counts)
        rows = from_bytes(received.column("factors"), kinds[1])[1].reshape(len(ids), k)
        # Column per counterpart, ordered by id.
        theirs = np.flatnonzero(~is_own)
        theirs = theirs[np.argsort(ids[theirs], kind="stable")]
        known = ids[theirs]
        vectors = np.ascontiguousarray(rows[theirs].T)

        lengths, other = from_bytes(histories.column("others"), other_kind)
        n, w, wr = (numbers_of(histories.column(name), lengths) for name in ("n", "w", "wr"))
        at = np.searchsorted(known, other)
        found = at < len(known)
        found[found] = known[at[found]] == other[found]
        entity = np.repeat(np.arange(len(lengths)), lengths)
        if not found.all():
            at, n, w, wr, entity = at[found], n[found], w[found], wr[found], entity[found]
            lengths = np.bincount(entity, minlength=len(lengths))

        own_ids = histories.column(own_col).to_numpy()
        split = histories.column("split").to_numpy()
        if item_side:
            own_c = histories.column("c").to_numpy()
            coef = w - n * own_c[entity]
            scale = own_c
        else:
            own_c = np.zeros(len(own_ids))
            # Only rows of counterparts have c.
            their_c = np.zeros(len(ids))
            their_c[~is_own] = from_bytes(received.column("c"), "float64")[1]
            coef = w - n * their_c[theirs][at]
            scale = np.ones(len(own_ids))

        partial_ids, partial_c, partials = [], [], []
        starts = kernels.ragged_starts(lengths)
        for e in np.flatnonzero(split & (lengths > 0)):
            seen = slice(starts[e], starts[e] + lengths[e])
            a, b = kernels.normal_equations(vectors, at[seen], coef[seen], wr[seen])
            partial_ids.append(own_ids[e])
            partial_c.append(own_c[e])
            partials.append(kernels.pack(a, b))

        entire = ~split & (lengths > 0)
        if not entire.all():
            inside = entire[entity]
            at, coef, wr = at[inside], coef[inside], wr[inside]
            lengths, own_ids = lengths[entire], own_ids[entire]
            own_c, scale = own_c[entire], scale[entire]
        x = np.zeros((len(own_ids), k))
        if warm and len(own_ids):
            mine = np.flatnonzero(is_own)
            mine = mine[np.argsort(ids[mine], kind="stable")]
            if len(mine):
                spot = np.minimum(np.searchsorted(ids[mine], own_ids), len(mine) - 1)
                has = ids[mine][spot] == own_ids
                x[has] = rows[mine[spot[has]]]
        if len(own_ids):
            if method == "sweep":
                x = kernels.sweep(x, vectors, at, lengths, coef, wr, scale, cache, lam)
            else:
                x = kernels.solve(vectors, at, lengths, coef, wr, scale, cache, lam)
        return table(own_ids, own_c, x, partial_ids, partial_c, partials)

    return update


def finish_split(
    layout: Layout,
    result: DataFrame,
    own: DataFrame | None,
    how: Update,
    cache: np.ndarray,
    schema: str,
) -> DataFrame:
    """Add up the partial equations of split entities and update them.

    The sum runs element by element with map-side combining; what is gathered per entity is
    one packed system of K*(K+1)/2 + K numbers.
    """
    item_side = layout.own == "item_idx"
    keys = [layout.own, "c_i"] if item_side else [layout.own]
    systems = (
        result.where(F.col("partial").isNotNull())
        .select(*keys, F.posexplode("partial").alias("pos", "value"))
        .groupBy(*keys, "pos")
        .agg(F.sum("value").alias("value"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
        .select(*keys, F.col("cells.value").alias("system"))
    )
    if own is not None:
        starts = own.select(layout.own, F.col("factors").alias("start"))
        systems = systems.join(starts, layout.own, "left")
    k, lam, method, started = how.k, how.lam, how.method, own is not None
    own_col, value_type = layout.own, ARROW_TYPE[how.storage]

    def update(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, kernels.SOLVE_BATCH):
                part = batch.slice(low, kernels.SOLVE_BATCH)
                a, b = kernels.unpack(matrix_of(part.column("system")), k)
                c = part.column("c_i").to_numpy() if item_side else None
                a += cache if c is None else c[:, None, None] * cache
                a += lam * np.eye(k)
                if method == "sweep":
                    x = np.zeros((len(b), k))
                    if started:
                        starts = part.column("start")
                        has = starts.is_valid().to_numpy(zero_copy_only=False)
                        x[has] = matrix_of(starts.drop_null(), k)
                    x = kernels.sweep_systems(x, a, b)
                else:
                    x = np.linalg.solve(a, b[:, :, None])[:, :, 0]
                    kernels.check_finite(x)
                ids = part.column(own_col).to_numpy()
                yield pa.RecordBatch.from_pydict(factor_batch(own_col, ids, c, x, value_type))

    return systems.mapInArrow(update, schema)
