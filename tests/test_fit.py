import importlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tacit.operators import (
    complete_confidence, complete_factors, gram, init_factors, item_confidence, item_popularity,
)
from tacit.plans import (
    FitOptions, als_items, als_users, fit, fit_uniform, fit_with_telemetry, prepare,
    sweep_items, sweep_users,
)

from tacit.scratch import scratch_root

INTERACTIONS = "user_idx int, item_idx int, rating float"


def vectors(df):
    return {r[0]: np.array(r[1], dtype=float) for r in df.collect()}


def start(spark, col, n, storage="double"):
    rows = [(e, [(e + 1) * (f + 1) / 1000 for f in range(2)]) for e in range(n)]
    return spark.createDataFrame(rows, f"{col} int, factors array<{storage}>")


GOLDEN = {
    (512.0, "cold"): (
        [
            (0.5991611743559018, 1.191649113675222),
            (0.2625703856711886, 0.33444129572909737),
            (0.49067314271667417, 0.9120037585468891),
            (0.37319241021664856, 0.579791733150899),
            (0.2625703856711886, 0.33444129572909737),
        ],
        [
            (0.03459962312647764, -0.002275947879231549),
            (0.06355559398306783, 0.004069299387914633),
            (0.06498811603141504, 0.020904868216058338),
        ],
    ),
    (512.0, "warm"): (
        [
            (0.599155582184941, 1.1916491292461038),
            (0.2615722626224203, 0.3346225247941261),
            (0.4904492981418743, 0.9120116670439593),
            (0.3721201066253146, 0.5799114022283601),
            (0.2600750780492678, 0.33489436839166914),
        ],
        [
            (0.030812308732713182, -0.00022470863998436767),
            (0.05750826867388141, 0.008039160194066995),
            (0.05796264531365453, 0.0264976401883266),
        ],
    ),
    (1.0, "cold"): (
        [
            (0.5991611743559018, 1.191649113675222),
            (0.29976694830315426, 0.5976752629579556),
            (0.4993335961218847, 0.9933642700523894),
            (0.39954517933772987, 0.7954682860649714),
            (0.29976694830315426, 0.5976752629579556),
        ],
        [
            (2.0114104303895246, 0.013228158350878042),
            (1.9900454917775612, 0.01210341919656529),
            (1.7975755054217517, 0.010862827134367434),
        ],
    ),
    (1.0, "warm"): (
        [
            (0.599155582184941, 1.1916491292461038),
            (0.2997607335912384, 0.5976752725911662),
            (0.49931760242880996, 0.9933643125156396),
            (0.399526986511239, 0.7954683272966906),
            (0.29975141152336454, 0.5976752870409823),
        ],
        [
            (2.007522941627568, 0.015200455055349445),
            (1.9822220243026927, 0.01604666686912164),
            (1.7858211590269295, 0.016774608750780115),
        ],
    ),
}


@pytest.fixture(scope="module")
def prepared(mock):
    return prepare(mock, k=2)


@pytest.mark.parametrize("c0,begin", list(GOLDEN))
@pytest.mark.parametrize("chunk", [None, 1])
def test_golden_iteration(spark, prepared, c0, begin, chunk):
    c = item_confidence(prepared.popularity, c0)
    o = FitOptions(k=2, start=begin, storage="double", chunk_pairs=chunk)
    p0, q0 = start(spark, "user_idx", 5), start(spark, "item_idx", 3)
    p = sweep_users(prepared.interactions, q0, c, o, p0)
    q = sweep_items(prepared.interactions, p, c, o, q0)
    users, items = GOLDEN[c0, begin]
    got_p, got_q = vectors(p), vectors(q)
    for got, want in ((got_p, users), (got_q, items)):
        assert len(got) == len(want)
        for e, row in enumerate(want):
            np.testing.assert_allclose(got[e], row, atol=1e-9)


def make(spark, rows):
    return spark.createDataFrame(rows, INTERACTIONS)


def random_rows(n_users, n_items, n, seed=1, repeats=False):
    rng = np.random.default_rng(seed)
    u, i = rng.integers(0, n_users, n), rng.integers(0, n_items, n)
    rows = [(int(a), int(b), 1.0) for a, b in zip(u, i)]
    return rows if repeats else sorted(set(rows))


def dense_system(rows, v, own_axis, c, scale_by_own, lam):
    """Plain A, b per entity, straight from the objective."""
    k = next(iter(v.values())).shape[0]
    out = {}
    for e in sorted({r[own_axis] for r in rows}):
        seen = [r[1 - own_axis] for r in rows if r[own_axis] == e]
        a, b = lam * np.eye(k), np.zeros(k)
        for o, vec in v.items():
            weight = c[e] if scale_by_own else c[o]
            a += weight * np.outer(vec, vec)
        for o in seen:
            weight = c[e] if scale_by_own else c[o]
            a += (1 - weight) * np.outer(v[o], v[o])
            b += v[o]
        out[e] = (a, b)
    return out


def gauss_seidel(a, b, x):
    x = x.copy()
    for f in range(len(b)):
        x[f] = (b[f] - a[f] @ x + a[f, f] * x[f]) / a[f, f]
    return x


@pytest.mark.parametrize("begin", ["warm", "cold"])
@pytest.mark.parametrize("chunk", [None, 7])
def test_sweeps_against_numpy(spark, begin, chunk):
    rows = random_rows(40, 30, 400)
    df = make(spark, rows)
    k = 5
    c = {i: 0.1 + 0.02 * i for i in range(30)}
    conf = spark.createDataFrame(list(c.items()), "item_idx int, c_i double")
    p0 = init_factors(df, "user_idx", k, "normal", storage="double")
    q0 = init_factors(df, "item_idx", k, "normal", storage="double")
    p, q = vectors(p0), vectors(q0)
    o = FitOptions(k=k, start=begin, storage="double", chunk_pairs=chunk)
    zero = np.zeros(k)
    got = vectors(sweep_users(df, q0, conf, o, p0))
    for u, (a, b) in dense_system(rows, q, 0, c, False, o.lam).items():
        np.testing.assert_allclose(got[u], gauss_seidel(a, b, p[u] if begin == "warm" else zero))
    got = vectors(sweep_items(df, p0, conf, o, q0))
    for i, (a, b) in dense_system(rows, p, 1, c, True, o.lam).items():
        np.testing.assert_allclose(got[i], gauss_seidel(a, b, q[i] if begin == "warm" else zero))


@pytest.mark.parametrize("chunk", [None, 7])
def test_uniform_solves_against_numpy(spark, chunk):
    rows = random_rows(40, 30, 400)
    df = make(spark, rows + rows[:50])  # copies are merged
    o = FitOptions(k=4, storage="double", chunk_pairs=chunk, on_duplicate="distinct")
    p0 = init_factors(df, "user_idx", 4, "normal", storage="double")
    q0 = init_factors(df, "item_idx", 4, "normal", storage="double")
    w0 = {e: 0.01 for e in range(40)}
    got = vectors(als_users(df, q0, o))
    for u, (a, b) in dense_system(rows, vectors(q0), 0, w0, False, o.lam).items():
        np.testing.assert_allclose(got[u], np.linalg.solve(a, b))
    got = vectors(als_items(df, p0, o))
    for i, (a, b) in dense_system(rows, vectors(p0), 1, w0, True, o.lam).items():
        np.testing.assert_allclose(got[i], np.linalg.solve(a, b))


def objective(rows, p, q, c, lam):
    seen = {(u, i) for u, i, _ in rows}
    total = lam * sum((x @ x) for x in [*p.values(), *q.values()])
    for u, x in p.items():
        for i, y in q.items():
            s = x @ y
            total += (1 - s) ** 2 if (u, i) in seen else c[i] * s * s
    return total


def test_warm_fit_never_raises_the_objective(spark):
    rows = random_rows(30, 20, 250)
    df = make(spark, rows)
    pop = df.groupBy("item_idx").agg((F.count("*") / len(rows)).alias("f_i"))
    c = {r.item_idx: r.c_i for r in item_confidence(pop, 5.0).collect()}
    values = []
    o = FitOptions(k=4, c0=5.0, iterations=3, storage="double")
    fit(df, pop, o, lambda it, s, m: values.append(
        objective(rows, vectors(m.users), vectors(m.items), c, o.lam)))
    assert len(values) == 3
    assert values[0] >= values[1] >= values[2]


def test_fit_does_not_depend_on_placement(spark):
    df = make(spark, random_rows(30, 20, 250))
    pop = df.groupBy("item_idx").agg((F.count("*") / df.count()).alias("f_i"))
    results = []
    for width, blocks in (("1", 10_000), ("8", 20)):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            o = FitOptions(k=4, c0=2.0, iterations=2, storage="double", block_pairs=blocks)
            model = fit(df.repartition(int(width)), pop, o)
            results.append((vectors(model.users), vectors(model.items)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    for one, two in zip(*results):
        assert one.keys() == two.keys()
        for e in one:
            np.testing.assert_allclose(one[e], two[e], rtol=1e-9, atol=1e-12)


def test_popular_item_is_split_exactly(spark):
    # One item holds a third of all rows.
    rows = sorted({(u, 0, 1.0) for u in range(600)} | set(random_rows(600, 40, 1200)))
    df = make(spark, rows)
    conf = spark.range(40).selectExpr("cast(id as int) item_idx", "0.3D c_i")
    p0 = init_factors(df, "user_idx", 3, "normal", storage="double")
    q0 = init_factors(df, "item_idx", 3, "normal", storage="double")
    whole = vectors(sweep_items(df, p0, conf, FitOptions(k=3, storage="double"), q0))
    split = vectors(
        sweep_items(df, p0, conf, FitOptions(k=3, storage="double", chunk_pairs=100), q0))
    assert whole.keys() == split.keys()
    for e in whole:
        np.testing.assert_allclose(whole[e], split[e], rtol=1e-9)


def test_repeated_pairs(spark):
    df = make(spark, [(0, 0, 1.0)] * 5)
    conf = spark.createDataFrame([(0, 3.0)], "item_idx int, c_i double")
    q0 = spark.createDataFrame([(0, [1.0, 2.0])], "item_idx int, factors array<double>")
    o = FitOptions(k=2, start="cold", storage="double")
    with pytest.raises(Exception, match="non-positive denominator"):
        sweep_users(df, q0, conf, o).collect()
    once = FitOptions(k=2, start="cold", storage="double", on_duplicate="distinct")
    got = vectors(sweep_users(df, q0, conf, once))
    a = np.outer([1, 2], [1, 2]) + 0.01 * np.eye(2)
    np.testing.assert_allclose(got[0], gauss_seidel(a, np.array([1.0, 2.0]), np.zeros(2)))


def test_weights_and_missing_counterparts(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0, 2.0), (0, 1, 1.0, 0.5), (1, 7, 1.0, 1.0)],
        "user_idx int, item_idx int, rating float, weight double",
    )
    conf = spark.createDataFrame([(0, 0.3), (1, 0.2), (7, 0.1)], "item_idx int, c_i double")
    q0 = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [0.5, -1.0])], "item_idx int, factors array<double>")
    o = FitOptions(k=2, start="cold", storage="double")
    got = vectors(sweep_users(df, q0, conf, o))
    assert set(got) == {0}  # the only item of user 1 has no factors
    v, w, c = np.array([[1, 2], [0.5, -1]]), np.array([2, 0.5]), np.array([0.3, 0.2])
    a = (v * c[:, None]).T @ v + (v * (w - c)[:, None]).T @ v + 0.01 * np.eye(2)
    np.testing.assert_allclose(got[0], gauss_seidel(a, v.T @ w, np.zeros(2)))


def test_gram(spark):
    q = spark.createDataFrame(
        [(0, [1.0, 2.0], 0.5), (1, [3.0, -1.0], 2.0)],
        "item_idx int, factors array<float>, c_i double")
    plain = {(r.f, r.g): r.value for r in gram(q).collect()}
    assert plain == {(0, 0): 10, (0, 1): -1, (1, 0): -1, (1, 1): 5}
    weighted = {(r.f, r.g): r.value for r in gram(q, "c_i").collect()}
    assert weighted == {(0, 0): 18.5, (0, 1): -5, (1, 0): -5, (1, 1): 4}


def test_uniform_fit_keeps_idle_entities(spark):
    df = make(spark, random_rows(20, 10, 80))
    everyone = spark.range(25).selectExpr("cast(id as int) user_idx")
    all_items = spark.range(10).selectExpr("cast(id as int) item_idx")
    o = FitOptions(k=3, iterations=2, init="normal", on_duplicate="distinct", storage="double")
    model = fit_uniform(df, o, users=everyone, items=all_items)
    got = vectors(model.users)
    begin = vectors(init_factors(everyone, "user_idx", 3, "normal", storage="double"))
    assert len(got) == 25
    np.testing.assert_allclose(got[24], begin[24])


def test_telemetry(spark):
    df = make(spark, random_rows(30, 20, 300))
    test = df.groupBy("user_idx").agg(F.min("item_idx").alias("item_idx"))
    train = df.join(test, ["user_idx", "item_idx"], "left_anti")
    pop = train.groupBy("item_idx").agg((F.count("*") / train.count()).alias("f_i"))
    o = FitOptions(k=3, c0=2.0, iterations=2)
    model, report = fit_with_telemetry(train, test, pop, o, n_negatives=10, top=3)
    rows = report.orderBy("iteration").collect()
    assert [r.iteration for r in rows] == [1, 2]
    m, n = train.select("user_idx").distinct().count(), train.select("item_idx").distinct().count()
    assert rows[0].mops_elementwise == pytest.approx((m + n) * 9 / 1e6)
    assert rows[0].mops_exact == pytest.approx((m + n) * 27 / 1e6)
    assert rows[0].gain_factor == 3
    assert all(r.ndcg <= r.hit_ratio <= 1 for r in rows)


def test_completed_tables(spark):
    everyone = spark.range(5).selectExpr("cast(id as int) item_idx")
    known = spark.createDataFrame([(1, [9.0, 9.0])], "item_idx int, factors array<float>")
    got = vectors(complete_factors(everyone, known, "item_idx", 2))
    begin = vectors(init_factors(everyone, "item_idx", 2, "normal"))
    assert set(got) == set(range(5)) and list(got[1]) == [9.0, 9.0]
    assert all((got[i] == begin[i]).all() for i in (0, 2, 3, 4))
    weights = spark.createDataFrame([(1, 2.5)], "item_idx int, c_i double")
    assert {r.item_idx: r.c_i for r in complete_confidence(everyone, weights).collect()} == {
        0: 0.0, 1: 2.5, 2: 0.0, 3: 0.0, 4: 0.0}


def stored_tables(spark):
    """Folders of the shared folder that hold files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tacit")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(root)} if fs.exists(root) else set()


def folders_of(*frames):
    return {file.split("/")[-2] for frame in frames for file in frame.inputFiles()}


@pytest.mark.parametrize("how", ["fit", "uniform", "telemetry"])
def test_only_the_tables_of_the_model_stay(spark, how):
    data = spark.createDataFrame(
        [(u, i, 1.0) for u in range(12) for i in range(9) if (u * i) % 4 != 1],
        "user_idx int, item_idx int, rating float",
    )
    popularity = data.groupBy("item_idx").agg((F.count("*") / 81).alias("f_i"))
    before = stored_tables(spark)
    options = FitOptions(k=2, iterations=2, c0=4.0, chunk_pairs=4)
    if how == "fit":
        model = fit(data, popularity, options)
    elif how == "uniform":
        idle = data.unionByName(make(spark, [(50, 60, 1.0)]))
        model = fit_uniform(data, options, users=idle, items=idle)
    else:
        model, _ = fit_with_telemetry(data, data.where("item_idx = 2"), popularity, options)
    assert stored_tables(spark) - before == folders_of(model.users, model.items)
    assert model.users.count() >= 12 and model.items.count() >= 9


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_a_cluster_needs_a_shared_folder(master):
    class Context:
        def getCheckpointDir(self):
            return None

    session = type("Session", (), {})()
    session.conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
    session.sparkContext = Context()
    session.sparkContext.master = master
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_root(session)


# The package exports the function under the module's name.
fit_module = importlib.import_module("tacit.plans.fit")


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_a_stopped_fit_goes_on(spark, tmp_path, monkeypatch, stop):
    """Stopped behind any half-step, a fit resumes there and gives the model of an unbroken one."""
    data = spark.range(400).selectExpr(
        "cast(id % 23 as int) user_idx", "cast((id * id) % 31 as int) item_idx").distinct()
    popularity = item_popularity(data)
    options = FitOptions(k=3, iterations=2, on_duplicate="distinct", storage="double")
    want = fit(data, popularity, options)
    log, steps = str(tmp_path / "log"), []
    real = fit_module.step

    def counted(layout, *rest):
        if len(steps) == stop:
            raise Stopped
        steps.append(1)
        return real(layout, *rest)

    monkeypatch.setattr(fit_module, "step", counted)
    with pytest.raises(Stopped):
        fit(data, popularity, options, log=log)
    assert len(steps) == stop
    more = []
    monkeypatch.setattr(fit_module, "step", lambda *all_: more.append(1) or real(*all_))
    got = fit(data, popularity, options, log=log)
    assert len(more) == 4 - stop

    def close(a, b, col):
        a, b = ({r[col]: r.factors for r in t.collect()} for t in (a, b))
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a)

    close(got.users, want.users, "user_idx")
    close(got.items, want.items, "item_idx")
    # A finished fit runs nothing again, a longer one goes on, another one is an error.
    close(fit(data, popularity, options, log=log).items, want.items, "item_idx")
    assert len(more) == 4 - stop
    fit(data, popularity, replace(options, iterations=3), log=log)
    assert len(more) == 6 - stop
    with pytest.raises(ValueError, match="another fit"):
        fit(data, popularity, replace(options, k=4), log=log)
    parts = [p.name for p in (tmp_path / "log").iterdir() if p.name != "manifests"]
    assert len(parts) <= 3
