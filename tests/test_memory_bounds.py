"""Sizes that bound what a task holds, whatever the size of the tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tacit.operators import evaluation, layout, leave_one_out, negative_lists, rank_drawn, scoring, updates


@pytest.mark.parametrize("k,storage", [(2, "float"), (16, "float"), (128, "double")])
def test_vectors_of_a_block(k, storage):
    """A block never pulls more than 32 MB of counterpart vectors, a vector per pair at most."""
    pairs = layout.default_block_pairs(k, storage)
    assert pairs * k * {"float": 4, "double": 8}[storage] <= 32 << 20 or pairs == 1 << 14


def test_item_rows_of_a_block():
    """Short vectors are bounded by their number: an id and its row cost more than they do."""
    class Session:
        class sparkContext:
            defaultParallelism = 12

    chunks, blocks = scoring._grid(Session, 535_000_000, 5_400_000, 7_200_000, 2, 64 << 20)
    assert 7_200_000 / blocks <= 2 << 20 and 5_400_000 / chunks <= 4 << 20


def test_hidden_rows_are_found_once(spark):
    """Train reads the stored hidden rows."""
    df = spark.range(600).selectExpr(
        "cast(id % 20 as int) user_idx", "cast((id * id + id) % 37 as int) item_idx",
        "cast(if(id % 7 = 0, null, id % 3) as float) rating")
    train, test = leave_one_out(df)
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    # Of the copies of a pair the least row is kept, null before all.
    rated = df.groupBy("user_idx", "item_idx").agg(F.min(F.struct("rating")).alias("r"))
    got = test.join(rated, ["user_idx", "item_idx"]).where(~F.col("rating").eqNullSafe(F.col("r.rating")))
    assert got.count() == 0 and test.count() == 20
    assert test.where("rating is null").count() > 0


def test_seen_pairs_are_dealt_to_all_tasks_before_they_are_made_distinct(spark, monkeypatch):
    plans = {}
    real = evaluation.materialize

    def record(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(evaluation, "materialize", record)
    seen = spark.range(200).selectExpr("cast(id % 9 as int) user_idx", "cast(id % 40 as int) item_idx")
    items = spark.range(60).selectExpr("cast(id as int) item_idx")
    negative_lists(seen.limit(5), items, 3, mode="unseen", seen=seen)
    top = plans["seen"].splitlines()
    assert "Aggregate" in top[0] and "RepartitionByExpression" in top[1]


def test_histories_are_packed_by_block():
    """A row per entity (or chunk, or weight), without a list aggregate over all pairs."""
    pairs = pa.table({
        "block": pa.array([3] * 6, pa.int32()),
        "item_idx": pa.array([5, 2, 5, 2, 5, 9], pa.int32()),
        "user_idx": pa.array([1, 4, 0, 7, 2, None], pa.int32()),
        "n": [1.0, 1.0, 2.0, 1.0, 1.0, 1.0],
        "w": [1.0] * 6,
        "wr": [1.0] * 6,
        "c": [0.5, 0.25, 0.5, 0.25, 0.75, 0.5],
    })
    got = layout.pack_histories("item_idx", "user_idx", "int32")(pairs)
    assert got.column("item_idx").to_pylist() == [2, 5, 5, 9]
    assert got.column("c").to_pylist() == [0.25, 0.5, 0.75, 0.5]
    lengths, others = layout.from_bytes(got.column("others"), "int32")
    assert lengths.tolist() == [2, 2, 1, 1] and others.tolist()[:5] == [4, 7, 1, 0, 2]
    assert updates.numbers_of(got.column("n"), lengths).tolist() == [1.0, 1.0, 1.0, 2.0, 1.0, 1.0]


def test_messages_are_rows_of_many_vectors(spark):
    """A row per batch and block, not per vector; no element goes through the JVM by itself."""
    data = spark.range(6000).selectExpr(
        "cast(id % 300 as int) user_idx", "cast(id * 7 % 500 as int) item_idx", "1D n", "1D w", "1D wr", "0.5D c_i")
    made = layout.build_layout(data, 6000, "user", 1 << 14)
    try:
        assert not [kind for _, kind in made.histories.dtypes + made.routes.dtypes if kind.startswith("array")]
        vectors = spark.range(500).selectExpr("cast(id as int) item_idx", "array(float(id), 1F) factors", "0.5D c_i")
        kinds = updates.message_kinds(made, vectors, None)
        got = updates.messages(made, vectors, None, kinds).toArrow()
        counts, ids = layout.from_bytes(got.column("ids"), kinds[0])
        sent = set(zip(np.repeat(got.column("block").to_numpy(), counts).tolist(), ids.tolist()))
        home = data.select(made.home(F.col("user_idx")), "item_idx").distinct().collect()
        assert sent == {tuple(row) for row in home} and len(ids) == len(sent)
        assert got.num_rows < len(ids) / 4
        first = layout.from_bytes(got.column("factors"), kinds[1])[1].reshape(-1, 2)[:, 0]
        assert (first == ids).all()
    finally:
        made.release()


def test_tables_of_millions_of_short_rows_are_not_broadcast(spark, monkeypatch):
    """The driver builds a broadcast, and a short row costs it several times its elements."""
    sizes = (3_000_000, 3_250_000, 2)
    monkeypatch.setattr(scoring, "table_sizes", lambda users, items: sizes)
    monkeypatch.setattr(evaluation, "table_sizes", lambda users, items: sizes, raising=False)
    stored, real = [], evaluation.store

    def record(df, name):
        made = real(df, name)
        if name == "places":
            # Numbering broadcasts a row per task.
            made.rows = sizes[1]
        else:
            stored.append(df)
        return made

    monkeypatch.setattr(evaluation, "store", record)
    users = spark.range(30).selectExpr("cast(id as int) user_idx", "array(1f, cast(id as float)) factors")
    items = spark.range(30).selectExpr("cast(id * 2 as int) item_idx", "array(cast(id as float), 1f) factors")
    test = spark.range(30).selectExpr("cast(id as int) user_idx", "cast(id * 4 % 60 as int) item_idx")
    # The ranks are planned only: their places are those of the sizes above.
    plans = [rank_drawn(test, users, items), scoring.score_pairs(test, users, items), *stored]
    assert len(stored) == 1
    for df in plans:
        assert "strategy=broadcast" not in df._jdf.queryExecution().analyzed().toString()
