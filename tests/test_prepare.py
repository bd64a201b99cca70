from collections import Counter

import pytest
from pyspark.sql import functions as F

from tacit.operators import (
    dense_index, entity_history, item_confidence, item_popularity, kcore, peel,
    threshold_filter, top_n_filter,
)
from tacit.operators import filters
from tacit.plans import prepare
from tacit.sources import implicit, read_feedback, scan_feedback


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_kcore_golden(mock):
    core = kcore(mock, "user_id", "business_id", 2)
    assert pairs(core) == [
        ("ann", "kiwi"), ("ann", "lime"), ("ann", "plum"),
        ("bob", "kiwi"), ("bob", "lime"),
        ("cy", "lime"), ("cy", "plum"),
        ("eve", "kiwi"), ("eve", "plum"),
        ("gus", "kiwi"), ("gus", "lime"),
    ]
    assert peel(mock, "user_id", "business_id", 2).passes == 2


def test_kcore_empty(mock):
    found = peel(mock, "user_id", "business_id", 3)
    assert found.passes == 3
    assert kcore(mock, "user_id", "business_id", 3).count() == 0


def test_kcore_null_and_copies(spark):
    df = spark.createDataFrame([(None, "a"), ("x", "a"), ("x", "b")], "u string, i string")
    assert pairs(kcore(df, "u", "i", 1)) == [("x", "a"), ("x", "b")]
    # Rows count, not distinct partners: two copies satisfy k=2, and both stay.
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a")], "u string, i string")
    assert pairs(kcore(df, "u", "i", 2)) == [("x", "a"), ("x", "a")]


def test_kcore_long_chain(spark):
    # A chain sheds one link per pass, which exercises small frontiers and rewrites.
    rows = [(f"u{n}", f"i{n}") for n in range(14)] + [(f"u{n}", f"i{n+1}") for n in range(14)]
    rows += [(u, i) for u in ("a", "b") for i in ("p", "q")]
    df = spark.createDataFrame(rows, "u string, i string")
    found = peel(df, "u", "i", 2)
    assert found.passes > 6
    assert pairs(kcore(df, "u", "i", 2)) == sorted((u, i) for u in "ab" for i in "pq")


def test_threshold_is_simultaneous(mock):
    kept = threshold_filter(mock, "user_id", "business_id", 2)
    # dee has one row; date, fig, pear and quince have one row each.
    assert kept.count() == 11
    assert threshold_filter(mock, "user_id", "business_id", 3).count() == 7


def test_top_n(mock):
    kept = top_n_filter(mock, "user_id", "business_id", 2, 1)
    # bob and eve tie for the second place, kiwi and lime for the first.
    assert pairs(kept) == [("ann", "kiwi"), ("bob", "kiwi")]
    assert top_n_filter(mock, "user_id", "business_id", None, None).count() == 15


def test_prepare_golden(mock):
    got = prepare(mock, k=2)
    assert dict(pairs(got.users)) == {"ann": 0, "bob": 1, "cy": 2, "eve": 3, "gus": 4}
    assert dict(pairs(got.items)) == {"kiwi": 0, "lime": 1, "plum": 2}
    assert dict(pairs(got.popularity)) == {0: 4 / 11, 1: 4 / 11, 2: 3 / 11}
    assert [f.dataType.simpleString() for f in got.interactions.schema] == ["int", "int", "float"]
    c = dict(pairs(item_confidence(got.popularity)))
    assert c[0] == pytest.approx(177.08289778581565, rel=1e-12)
    assert c[2] == pytest.approx(157.83420442836874, rel=1e-12)
    assert sum(c.values()) == pytest.approx(512)


def test_index_ties_and_order(spark):
    df = spark.createDataFrame([(9,), (9,), (10,), (2,)], "id int")
    got = dict(pairs(dense_index(df, "id")))
    assert got == {9: 0, 10: 1, 2: 2}
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "id string, at int")
    assert dict(pairs(dense_index(df, "id", "first_seen", "at"))) == {"c": 0, "b": 1, "a": 2}
    with pytest.raises(ValueError):
        dense_index(df, "id", "first_seen")


@pytest.mark.parametrize("width", [1, 7])
def test_index_is_a_bijection(spark, width):
    df = spark.range(2000).select((F.col("id") * F.col("id") % 701).alias("v")).repartition(width)
    rows = dense_index(df, "v").collect()
    assert sorted(r.idx for r in rows) == list(range(len(rows)))
    counts = {r.v: r["count"] for r in df.groupBy("v").count().collect()}
    ranked = [r.v for r in sorted(rows, key=lambda r: r.idx)]
    assert ranked == sorted(counts, key=lambda v: (-counts[v], str(v)))


def test_history_parts(spark):
    rows = [(0, i % 50, 1.0) for i in range(1000)] + [(1, 3, 1.0), (1, 3, 1.0), (1, 2, 1.0)]
    df = spark.createDataFrame(rows, "user_idx int, item_idx int, rating float")
    got = entity_history(df, "user_idx", part_rows=100).collect()
    small = [r for r in got if r.user_idx == 1]
    assert [(e.other, e.rating) for e in small[0].events] == [(2, 1.0), (3, 1.0), (3, 1.0)]
    large = [r for r in got if r.user_idx == 0]
    assert len(large) > 1
    assert sorted(e.other for r in large for e in r.events) == sorted(i % 50 for i in range(1000))
    # One pair with very many copies is spread too.
    one = spark.range(1000).selectExpr("0 user_idx", "5 item_idx", "1.0f rating")
    parts = entity_history(one, "user_idx", part_rows=100).collect()
    assert sum(len(r.events) for r in parts) == 1000 and len(parts) > 1


def test_json_scan(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"user_id":"u","business_id":"b","text":"x","stars":5}\n{"user_id":"v","business_id":"c"}\n'
    )
    df = implicit(read_feedback(spark, str(tmp_path)))
    assert pairs(df) == [("u", "b", 1.0), ("v", "c", 1.0)]
    assert df.schema["rating"].dataType.simpleString() == "float"


def test_popularity_sums_to_one(spark):
    df = spark.createDataFrame([(0, i % 7) for i in range(50)], "user_idx int, item_idx int")
    total = item_popularity(df).agg(F.sum("f_i")).first()[0]
    assert total == pytest.approx(1.0)


def test_broken_lines_are_counted_and_set_aside(spark, tmp_path):
    good = ['{"user_id": "a", "business_id": "x", "text": "}{"}', ' {"business_id": "y"}', '{"user_id": 5, "business_id": null}']
    broken = ['{"user_id": "b", "business_id": "z"', "not json", "[1, 2]", "17", '{"user_id": "c" "business_id": "d"}']
    (tmp_path / "a.json").write_text("\n".join([*good, "", *broken[:2], "  "]))
    (tmp_path / "b.json").write_text("\n".join(broken[2:]))
    scan = scan_feedback(spark, str(tmp_path))
    assert sorted(map(tuple, scan.rows.collect()), key=repr) == [("5", None), ("a", "x"), (None, "y")]
    assert scan.seen.get == {"lines": 8, "rejected": 5, "incomplete": 2}
    aside = scan.rejected.collect()
    assert sorted(r.line for r in aside) == sorted(broken)
    assert {r.file.rpartition("/")[2] for r in aside} == {"a.json", "b.json"}
    assert implicit(read_feedback(spark, str(tmp_path))).count() == 3


@pytest.mark.parametrize("scans", [0, 1, 99])
def test_peeling_by_bucket(spark, monkeypatch, scans):
    """A chain that loses a link or two a pass: late passes read a few buckets only."""
    monkeypatch.setattr(filters, "BUCKET_PAIRS", 8)
    links = [(f"u{i}", f"i{j}") for i in range(9) for j in (i, i + 1)]
    core = [(f"c{a}", f"d{b}") for a in range(40) for b in range(12)]
    copies = [("lone", "x")] * 3 + [("u0", "i0")]
    df = spark.createDataFrame(links + core + copies, "u string, i string")
    got, read = filters._peel(df, "u", "i", 2, scans)
    again = filters.peel(df, "u", "i", 2)
    assert pairs(got.users) == pairs(again.users) and pairs(got.items) == pairs(again.items)
    left = list(links + core + copies)
    passes = 0
    while True:
        passes += 1
        before = len(left)
        for at in (0, 1):
            counts = Counter(pair[at] for pair in left)
            left = [pair for pair in left if counts[pair[at]] >= 2]
        if len(left) == before:
            break
    assert got.passes == again.passes == passes
    assert pairs(filters.kcore(df, "u", "i", 2)) == sorted(left)
    total = len(set(links + core + copies))
    assert all(n <= total / 4 for n in read[2:]) and (len(read) > 5) == (scans < 99 and passes > 6)
