"""Ranking of many cases: no list of negatives is broadcast, stored without need or named row by row."""

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tacit.functions import draw

from tacit.operators import (
    evaluate, negative_lists, rank_drawn, rank_lists, score_pairs,
)
from tacit.operators import drawn, evaluation, scoring


@pytest.fixture(scope="module")
def model(spark):
    p = spark.range(40).selectExpr(
        "cast(id as int) user_idx", "array(cast(id % 5 as float), cast(id % 3 as float), 0.5f) factors")
    test = spark.range(500).selectExpr(
        "cast(id % 45 as int) user_idx", "cast((id * id) % 130 as int) item_idx")
    return p.localCheckpoint(), test.localCheckpoint()


def items(spark, step):
    return spark.range(60).selectExpr(
        f"cast(id * {step} as int) item_idx",
        "array(cast(id % 4 as float), 1.0f, cast(id % 2 as float)) factors").localCheckpoint()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("step", [1, 2])
@pytest.mark.parametrize("block", [24, 1 << 20])
@pytest.mark.parametrize("mode", ["uniform", "unseen"])
def test_drawn_ranks_equal_ranks_of_lists(spark, model, monkeypatch, step, block, mode):
    p, test = model
    q = items(spark, step)
    cases = test.select("user_idx", F.col("item_idx").alias("true_item")).distinct()
    lists = negative_lists(test, q, 11, mode=mode, seen=test)
    want = rows(rank_lists(cases, lists, p, q))
    monkeypatch.setattr(evaluation, "LIST_SPAN", 4)
    got = rank_drawn(test, p, q, 11, mode=mode, seen=test, broadcast_bytes=0, block_bytes=block)
    assert rows(got) == want and len(want) > 100


def stored(monkeypatch):
    """Names and plans of the tables that scoring and evaluation store."""
    seen = []
    real = scoring.store

    def record(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString(), df.columns))
        return real(df, name)

    monkeypatch.setattr(scoring, "store", record)
    monkeypatch.setattr(evaluation, "store", record)
    return seen


def test_lists_are_not_broadcast(spark, model, monkeypatch):
    """A drawn list looks as small as its case to the planner."""
    p, test = model
    seen = stored(monkeypatch)
    q = items(spark, 1)
    cases = test.select("user_idx", F.col("item_idx").alias("true_item")).distinct()
    rank_lists(cases, negative_lists(test, q, 99), p, q).collect()
    (plan,) = [plan for name, plan, _ in seen if name == "lists"]
    # The first join of the printed plan is the last one to run: lists with scores.
    assert re.search(r"\w+Join", plan).group() == "SortMergeJoin"


@pytest.mark.parametrize("step", [1, 2])
def test_uniform_lists_are_neither_stored_nor_named(spark, model, monkeypatch, step):
    p, test = model
    q = items(spark, step)
    seen = stored(monkeypatch)
    monkeypatch.setattr(evaluation.Places, "named", None)
    got = evaluate(test, p, q, 99)
    assert got.first().n_covered > 100
    assert not [name for name, _, columns in seen if "negatives" in columns]


def test_vectors_travel_as_they_are_stored(spark, model):
    p, test = model
    got = score_pairs(test, p, items(spark, 1), broadcast_bytes=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan


def test_grid_sends_few_vectors():
    class Session:
        class sparkContext:
            defaultParallelism = 12

    def sent(n_pairs, n_users, n_items, width):
        chunks, blocks = scoring._grid(Session, n_pairs, n_users, n_items, width, scoring.BLOCK_BYTES)
        assert -(-n_items * width * 8 // blocks) <= scoring.BLOCK_BYTES
        of_a_user = blocks * (1 - (1 - 1 / blocks) ** (n_pairs / n_users))
        return n_users * of_a_user + n_items * chunks

    assert sent(36_000_000, 900_000, 1_200_000, 32) < 36_000_000
    # Six times the pairs, and no pair's vector is sent for itself.
    assert sent(216_000_000, 5_400_000, 7_200_000, 32) < 216_000_000


def test_grid_of_small_blocks_sends_items_once():
    """Vectors sent grow no faster than the pairs; a cell's users are those of its pairs."""

    class Session:
        class sparkContext:
            defaultParallelism = 12

    n_pairs, n_users, n_items = 216_000_000, 5_400_000, 7_200_000
    assert scoring._grid(Session, n_pairs, n_users, n_items, 32, 100_000, 4)[0] == 1

    def per_pair(times):
        sizes = [n * times // 6 for n in (n_pairs, n_users, n_items)]
        chunks, blocks = scoring._grid(Session, *sizes, 32, scoring.BLOCK_BYTES, 4)
        return (sizes[1] * blocks + sizes[2] * chunks) / sizes[0]

    assert per_pair(6) < 0.6


def test_crowded_block_is_cut(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_PAIRS", 50)
    rows = [(u, i) for u in range(400) for i in {7, u % 20}]
    pairs = spark.createDataFrame(rows, "user_idx int, item_idx int")
    users = spark.createDataFrame([(u, [u + 0.5, 1.0]) for u in range(400)], "user_idx int, factors array<float>")
    items = spark.createDataFrame([(i, [1.0, i + 0.25]) for i in range(20)], "item_idx int, factors array<float>")
    got = scoring.score_pairs(pairs, users, items, broadcast_bytes=0, block_bytes=16)
    assert sorted(tuple(r) for r in got.collect()) == sorted((u, i, u + i + 0.75) for u, i in rows)


def test_draws_in_cells_are_draws_of_columns(spark):
    """Ids of several lengths, negative ones and such as make a message longer than a block."""
    pairs = [(0, 7), (12, 345), (2_000_000, 7_199_999), (-3, 12), (10**17, -(10**18) + 1), (-(2**63), 2**63 - 1)]
    df = spark.createDataFrame([(u, i, j) for u, i in pairs for j in (0, 9, 10, 99, 100)], "u long, i long, j int")
    want = {tuple(r[:3]): r[3] for r in df.select("*", draw(F.col("u"), F.col("i"), F.col("j"), seed=42)).collect()}
    for u, i in pairs:
        got = drawn.draw_heads(pa.array([f"{u}|{i}|"] * 2), 101, 42)
        assert [got[1, j] for j in (0, 9, 10, 99, 100)] == [want[u, i, j] for j in (0, 9, 10, 99, 100)]
    keys = pa.array(["x", "5|66|", "7|88|"])[1:]
    made = drawn.draw_heads(keys, 1200, 3)
    assert made.tolist() == [
        [int(hashlib.md5(f"{key}{j}|3".encode()).hexdigest()[:8], 16) for j in range(1200)] for key in keys.to_pylist()
    ]


@pytest.mark.parametrize("n", [0, 1, 99])
@pytest.mark.parametrize("step", [1, 2])
def test_ranks_in_parts_and_small_groups(spark, model, monkeypatch, step, n):
    """Several parts, blocks and groups give the ranks of the listed draws."""
    p, test = model
    q = items(spark, step)
    cases = test.select("user_idx", F.col("item_idx").alias("true_item")).distinct()
    want = rows(rank_lists(cases, negative_lists(test, q, n), p, q))
    for name, value in (("PART_BYTES", 240), ("GROUP_DRAWS", 300), ("SLICE_ELEMENTS", 64), ("CELL_DRAWS", 900)):
        monkeypatch.setattr(drawn, name, value)
    assert rows(rank_drawn(test, p, q, n, block_bytes=48)) == want and len(want) > 100


@pytest.mark.parametrize("block", [24, 1 << 20])
def test_no_shuffle_carries_draws(spark, model, block):
    """A case travels as one row with its user's vector, whatever the number of its draws."""
    p, test = model
    plan = rank_drawn(test, p, items(spark, 1), 99, block_bytes=block)._jdf.queryExecution().optimizedPlan()
    assert "negatives" not in plan.toString() and "array<int>" not in plan.toString()


def test_nan_is_an_error_in_cells(spark, model):
    p, test = model
    q = items(spark, 1).withColumn("factors", F.expr("if(item_idx = 3, array(float('nan'), 1f, 1f), factors)"))
    with pytest.raises(Exception, match="score is NaN"):
        rank_drawn(test.where("item_idx <> 3"), p, q, 99, broadcast_bytes=0).collect()


def test_small_blocks_bring_no_row_per_draw(spark, model, monkeypatch):
    """Blocks of two items: stored rows are cases or items, never a case times its blocks."""
    p, test = model
    q, counts = items(spark, 1), {}
    for module in (scoring, evaluation):
        def record(df, name, real=module.store):
            made = real(df, name)
            counts[name] = max(made.rows, counts.get(name, 0))
            return made

        monkeypatch.setattr(module, "store", record)
    got = rank_drawn(test, p, q, 99, broadcast_bytes=0, block_bytes=24)
    assert got.count() > 100 and max(counts.values()) <= test.distinct().count()
