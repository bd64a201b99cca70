import math

import pytest
from pyspark.sql import functions as F

from tacit.functions import draw, normal
from tacit.operators import (
    case_ranks, evaluate, leave_one_out, negative_candidates, prediction_error, random_split,
    negative_lists, rank_candidates, rank_gains, rank_lists, ranking_metrics, score_pairs,
)
from tacit.operators import evaluation, scoring, selection
from tacit.operators.selection import first_rows
from tacit.sources import FactorModel, load_model, save_model


@pytest.fixture(scope="module")
def seen(spark):
    return spark.range(600).selectExpr(
        "cast(id % 20 as int) user_idx", "cast((id * id + id) % 37 as int) item_idx",
        "1.0f rating").distinct()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_draw_matches_its_definition(spark):
    import hashlib
    got = spark.range(3).select(draw(F.col("id"), "x", seed=7).alias("d")).collect()
    want = [int(hashlib.md5(f"{i}|x|7".encode()).hexdigest()[:8], 16) for i in range(3)]
    assert [r.d for r in got] == want


def test_normal_moments(spark):
    stats = spark.range(20000).select(normal(F.col("id"), seed=3).alias("z")).agg(
        F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(stats.m) < 0.03 and abs(stats.s - 1) < 0.03


def test_random_split(spark):
    df = spark.range(5000)
    train, test = random_split(df, ["id"])
    assert train.count() + test.count() == 5000
    assert abs(train.count() - 4000) < 150
    again, _ = random_split(df.repartition(13), ["id"])
    assert rows(train) == rows(again)


@pytest.mark.parametrize("n", [5, None])
def test_leave_one_out(spark, seen, n):
    train, test = leave_one_out(seen, n)
    users = seen.select("user_idx").distinct().count()
    assert test.count() == (n or users)
    assert test.select("user_idx").distinct().count() == (n or users)
    assert train.join(test, ["user_idx", "item_idx"]).count() == 0
    assert train.count() + test.count() == seen.count()
    again = leave_one_out(seen.repartition(5), n)
    assert rows(again[1]) == rows(test)


def test_hidden_pair_leaves_with_all_copies(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 1.0)], "user_idx int, item_idx int, rating float")
    train, test = leave_one_out(df, None)
    assert (train.count(), test.count()) == (0, 1)


def test_copies_of_a_pair_are_hidden_as_often_as_rows(spark):
    """Of ten rows, nine are copies of one pair: it is hidden for nine users of ten."""
    df = spark.range(4000).selectExpr(
        "cast(id as int) user_idx", "explode(array_append(array_repeat(1, 9), 2)) item_idx")
    _, test = leave_one_out(df)
    assert abs(test.where("item_idx = 1").count() / 4000 - 0.9) < 0.02


def ids(spark, n, step=1):
    return spark.range(n).selectExpr(f"cast(id * {step} as int) item_idx")


def test_uniform_negatives(spark, seen):
    _, test = leave_one_out(seen, 5)
    got = negative_candidates(test, ids(spark, 37), 99)
    assert got.count() == 500
    assert got.where("is_true = 1").count() == 5
    assert got.agg(F.min("item_idx"), F.max("item_idx")).first()[1] <= 36


def test_negatives_come_from_the_given_items(spark, seen):
    """Gaps between ids: every draw still is an item of the frame, and all of them are drawn."""
    _, test = leave_one_out(seen)
    got = negative_candidates(test, ids(spark, 12, 1000), 99).where("is_true = 0")
    assert got.count() == 99 * test.count()
    assert {r.item_idx for r in got.select("item_idx").distinct().collect()} == set(
        range(0, 12000, 1000))


@pytest.mark.parametrize("n,n_items", [(5, 37), (5, 400), (30, 37), (8, 23)])
def test_unseen_negatives(spark, seen, n, n_items):
    train, test = leave_one_out(seen, None)
    train = train.where(f"item_idx < {n_items}")
    got = negative_candidates(test, ids(spark, n_items), n, mode="unseen", seen=train)
    false = got.where("is_true = 0")
    assert false.distinct().count() == false.count()
    assert false.join(train, ["user_idx", "item_idx"]).count() == 0
    assert false.join(test, ["user_idx", "item_idx"]).count() == 0
    have = {}
    for r in train.unionByName(test).collect():
        if r.item_idx < n_items:
            have.setdefault(r.user_idx, set()).add(r.item_idx)
    per_user = {r.user_idx: r["count"] for r in false.groupBy("user_idx").count().collect()}
    for user, items in have.items():
        assert per_user.get(user, 0) == min(n, n_items - len(items))


def test_unseen_negatives_of_several_cases_per_user(spark):
    """Users who have seen nearly all items share one list of the rest; cases differ in order."""
    train = spark.range(3 * 40).selectExpr(
        "cast(id % 3 as int) user_idx", "cast(id div 3 as int) item_idx").where("item_idx >= 6")
    test = spark.range(3 * 4).selectExpr(
        "cast(id % 3 as int) user_idx", "cast(id div 3 as int) item_idx")
    got = negative_candidates(test, ids(spark, 40), 3, mode="unseen", seen=train)
    cases = got.where("is_true = 0").groupBy("user_idx", "true_item").agg(
        F.collect_set("item_idx").alias("s"), F.count("*").alias("n")).collect()
    assert len(cases) == 12
    assert all(r.n == 3 == len(r.s) and r.true_item not in r.s and max(r.s) < 6 for r in cases)
    assert len({(r.user_idx, frozenset(r.s)) for r in cases}) > 3


def test_unseen_negatives_follow_the_draws(spark, seen, monkeypatch):
    train, test = leave_one_out(seen, None)
    one = rows(negative_candidates(test, ids(spark, 400), 5, mode="unseen", seen=train))
    monkeypatch.setattr(evaluation, "DRAWS_PER_NEGATIVE", 20)
    assert rows(negative_candidates(test, ids(spark, 400), 5, mode="unseen", seen=train)) == one


def test_ties_and_gains(spark):
    scored = spark.createDataFrame(
        [(0, 5, 5, 1, 0.5), (0, 5, 3, 0, 0.5), (0, 5, 5, 0, 0.5), (0, 5, 9, 0, 0.9),
         (0, 7, 7, 1, 0.1), (1, 2, 2, 1, float("-inf"))],
        "user_idx int, true_item int, item_idx int, is_true bigint, score double")
    ranked = rank_candidates(scored).where("user_idx = 0 AND true_item = 5")
    assert rows(ranked.select("rank", "item_idx", "is_true")) == [
        (1, 9, 0), (2, 3, 0), (3, 5, 1), (4, 5, 0)]
    # Cases of a user do not compete, and counting gives the rank of the window.
    assert rows(case_ranks(scored)) == [(0, 5, 3, 3), (0, 7, 1, 0), (1, 2, 1, 0)]
    ranks = spark.createDataFrame(
        [(u, 0, r) for u, r in enumerate([1, 10, 11])], "user_idx int, item_idx int, rank int")
    got = [r.ndcg for r in rank_gains(ranks).orderBy("rank").collect()]
    assert got == pytest.approx([1.0, math.log(2) / math.log(11), 0.0])
    assert got[1] == pytest.approx(0.2890648, abs=1e-6)


def test_coverage(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0])], "user_idx int, factors array<float>")
    q = spark.createDataFrame([(0, [0.5, 9.0])], "item_idx int, factors array<float>")
    test = spark.createDataFrame(
        [(0, 0, 1.0), (0, 7, 1.0)], "user_idx int, item_idx int, rating float")
    got = prediction_error(test, p, q).first()
    assert (got.n_test, got.n_covered, got.coverage, got.rmse) == (2, 1, 0.5, 0.5)
    none = prediction_error(test.where("item_idx = 7"), p, q).first()
    assert (none.n_covered, none.coverage, none.rmse) == (0, 0.0, None)
    empty = prediction_error(test.limit(0), p, q).first()
    assert (empty.n_test, empty.coverage, empty.rmse) == (0, None, None)
    metrics = evaluate(test.where("item_idx = 7"), p, q.where("item_idx = 1"), 5).first()
    assert (metrics.n_test, metrics.n_covered, metrics.hit_ratio) == (1, 0, None)


def test_nan_is_an_error(spark):
    p = spark.createDataFrame([(0, [float("nan")])], "user_idx int, factors array<float>")
    q = spark.createDataFrame([(0, [0.5])], "item_idx int, factors array<float>")
    pairs = spark.createDataFrame([(0, 0)], "user_idx int, item_idx int")
    with pytest.raises(Exception, match="NaN"):
        score_pairs(pairs, p, q).collect()


def test_perfect_ranking(spark):
    ranks = spark.createDataFrame(
        [(0, 1, 1, 4)], "user_idx int, item_idx int, rank int, n_candidates int")
    # A repeated test row counts twice; a row without a rank lowers the coverage.
    test = spark.createDataFrame([(0, 1), (0, 1), (0, 2)], "user_idx int, item_idx int")
    got = ranking_metrics(test, ranks).first()
    assert (got.n_test, got.n_covered, got.hit_ratio, got.ndcg) == (3, 2, 1.0, 1.0)
    assert (got.min_candidates, got.mean_candidates) == (4, 4.0)


def test_model_roundtrip(spark, tmp_path):
    model = FactorModel(
        spark.createDataFrame([(0, [1.0, 2.0])], "user_idx int, factors array<float>"),
        spark.createDataFrame([(3, [0.5, 1.5])], "item_idx int, factors array<float>"))
    save_model(model, str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert rows(back.users) == rows(model.users) and rows(back.items) == rows(model.items)


@pytest.fixture(scope="module")
def tables(spark):
    """Vectors with many ties, users and items without any, and pairs with repeats and a hot user."""
    p = spark.range(40).selectExpr(
        "cast(id as int) user_idx", "array(cast(id % 5 as float), cast(id % 3 as float), 0.5f) factors")
    q = spark.range(60).selectExpr(
        "cast(id * 2 as int) item_idx", "array(cast(id % 4 as float), 1.0f, cast(id % 2 as float)) factors")
    pairs = spark.range(3000).selectExpr(
        "cast(if(id % 3 = 0, 7, id % 45) as int) user_idx", "cast((id * id) % 130 as int) item_idx",
        "id % 2 AS _id", "concat('x', id) note")
    return p, q, pairs


@pytest.mark.parametrize("cell,block", [(1 << 20, 1 << 20), (100, 24 * 9), (7, 24)])
def test_cells_score_like_broadcasts(spark, tables, monkeypatch, cell, block):
    p, q, pairs = tables
    want = rows(score_pairs(pairs, p, q))
    monkeypatch.setattr(scoring, "CELL_PAIRS", cell)
    got = score_pairs(pairs, p, q, broadcast_bytes=0, block_bytes=block)
    assert rows(got) == want and len(want) > 1000
    # No vector travels by pair: it leaves its table by user or item only.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "factors" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert rows(score_pairs(pairs.limit(0), p, q, 0)) == []


@pytest.mark.parametrize("cell,block", [(1 << 20, 1 << 20), (50, 24 * 9), (7, 24)])
@pytest.mark.parametrize("mode", ["uniform", "unseen"])
def test_ranks_in_cells_equal_ranks_of_scores(spark, tables, monkeypatch, cell, block, mode):
    p, q, pairs = tables
    monkeypatch.setattr(scoring, "CELL_PAIRS", cell)
    monkeypatch.setattr(evaluation, "LIST_SPAN", 4)
    test = pairs.where("item_idx % 13 = 0").select("user_idx", "item_idx")
    known = q.where("item_idx < 60").unionByName(q.where("item_idx = 90"))
    seen = pairs.select("user_idx", "item_idx")
    lists = negative_lists(test, q, 11, mode=mode, seen=seen)
    one_by_one = negative_candidates(test, q, 11, mode=mode, seen=seen)
    cases = test.select("user_idx", F.col("item_idx").alias("true_item")).distinct()
    want = rows(case_ranks(score_pairs(one_by_one, p, known)))
    got = rank_lists(cases, lists, p, known, broadcast_bytes=0, block_bytes=block)
    assert rows(got) == want and len(want) > 12


def test_nan_in_a_cell_is_an_error(spark):
    p = spark.createDataFrame([(0, [float("nan")])], "user_idx int, factors array<float>")
    q = spark.createDataFrame([(0, [0.5])], "item_idx int, factors array<float>")
    pairs = spark.createDataFrame([(0, 0)], "user_idx int, item_idx int")
    with pytest.raises(Exception, match="NaN"):
        score_pairs(pairs, p, q, broadcast_bytes=0).collect()


@pytest.mark.parametrize("span", [3, 100_000])
@pytest.mark.parametrize("step", [1, 3])
def test_packed_seen_sets(spark, seen, monkeypatch, span, step):
    """Users with long histories, and ids with gaps, get what one anti-join per draw would give."""
    monkeypatch.setattr(evaluation, "SEEN_SPAN", span)
    train, test = leave_one_out(seen, None)
    train, test = (df.withColumn("item_idx", (F.col("item_idx") * step).cast("int")) for df in (train, test))
    got = negative_candidates(test, ids(spark, 300, step), 20, mode="unseen", seen=train).where("is_true = 0")
    drawn = test.select("user_idx", F.col("item_idx").alias("true_item")).crossJoin(spark.range(400).toDF("j"))
    place = evaluation._draw_place(300, F.col("j"), 42)
    pool = drawn.select("*", (place * step).alias("item_idx")).groupBy("user_idx", "true_item", "item_idx").agg(F.min("j").alias("j"))
    pool = pool.where("item_idx != true_item").join(train, ["user_idx", "item_idx"], "left_anti")
    want = evaluation._first(pool, 20).select("user_idx", "true_item", "item_idx")
    assert rows(got.select("user_idx", "true_item", "item_idx")) == rows(want)


def test_a_model_without_maps_hides_older_maps(spark, tmp_path):
    def table(col, n):
        return spark.createDataFrame([(i, [float(n)]) for i in range(n)], f"{col} int, factors array<float>")

    path = str(tmp_path / "m")
    ids_of = spark.createDataFrame([("a", 0)], "user_id string, user_idx int")
    save_model(FactorModel(table("user_idx", 2), table("item_idx", 3), ids_of, None), path)
    first = load_model(spark, path)
    assert rows(first.user_ids) == [("a", 0)] and first.item_ids is None
    save_model(FactorModel(table("user_idx", 4), table("item_idx", 5)), path)
    second = load_model(spark, path)
    assert (second.user_ids, second.item_ids, second.users.count()) == (None, None, 4)
    assert first.users.count() == 2  # the version before stays for its readers

    # A save that breaks in its second table leaves the current model whole.
    broken = second.items.withColumn("factors", F.array(F.raise_error(F.lit("lost")).cast("float")))
    with pytest.raises(Exception, match="lost"):
        save_model(FactorModel(table("user_idx", 9), broken), path)
    again = load_model(spark, path)
    assert (again.users.count(), again.items.count()) == (4, 5)

    # A model may be saved over the one it was read from; old versions go.
    for _ in range(3):
        save_model(load_model(spark, path), path)
    assert load_model(spark, path).users.count() == 4
    assert len(list((tmp_path / "m" / "manifests").glob("*.json"))) == 2
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("buckets,cut", [(4096, 100_000), (3, 5), (16, 1)])
@pytest.mark.parametrize("n", [0, 1, 57, 500, 1999, 2000, 9999])
def test_first_rows(spark, monkeypatch, buckets, cut, n):
    """Also with ties over the cut: a key has 100 rows."""
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    monkeypatch.setattr(selection, "CUT_ROWS", cut)
    df = spark.range(2000).selectExpr("id", "(id * 7919) % 20 * 1000 - 5000 AS n")
    got = first_rows(df, F.col("n"), ["id"], n)
    want = sorted(((r.id, r.n) for r in df.collect()), key=lambda r: (r[1], r[0]))[:n]
    assert rows(got) == sorted(want)


def test_first_rows_of_hundreds_of_thousands(spark):
    """Most rows tie; the taken ones stay spread over partitions and no plan limits or collects them."""
    df = spark.range(400_000).selectExpr("id AS user_idx", "if(id % 10 = 0, 2, 1) AS n")
    got = first_rows(df, -F.col("n"), ["user_idx"], 300_000)
    assert got.count() == 300_000
    assert got.where("n = 2").count() == 40_000
    assert got.where("n = 1").agg(F.max("user_idx")).first()[0] == 288_888
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "SinglePartition" not in plan


def test_rmse_coverage_draws_once(monkeypatch):
    """Both parts of the split are stored; their readers do not draw again."""
    from tacit.plans import catalog

    seen = []

    class Part:
        pass

    monkeypatch.setattr(catalog, "interactions", lambda *_: Part())
    monkeypatch.setattr(catalog, "random_split", lambda *_: ("drawn train", "drawn test"))
    monkeypatch.setattr(catalog, "materialize", lambda df, name: f"stored {name}")
    monkeypatch.setattr(catalog, "item_popularity", lambda df: seen.append(df))

    def stop(df, *_):
        seen.append(df)
        raise StopIteration

    monkeypatch.setattr(catalog, "fit", stop)
    with pytest.raises(StopIteration):
        catalog.rmse_coverage(None, "")
    assert seen == ["stored train", "stored train"]
