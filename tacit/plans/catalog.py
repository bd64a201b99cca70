"""Registered queries: every operator run over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tacit.operators import (
    apply_index,
    case_ranks,
    complete_confidence,
    complete_factors,
    dense_index,
    entity_history,
    gram,
    init_factors,
    item_confidence,
    item_popularity,
    kcore,
    leave_one_out,
    negative_candidates,
    prediction_error,
    random_split,
    rank_candidates,
    rank_drawn,
    ranking_metrics,
    score_pairs,
    threshold_filter,
    top_n_filter,
    weighted_items,
)
from tacit.plans.fit import (
    FitOptions,
    als_items,
    als_users,
    fit,
    fit_uniform,
    fit_with_telemetry,
    operation_counts,
    sweep_items,
    sweep_users,
)
from tacit.plans.prepare import prepare
from tacit.scratch import materialize, scratch_path
from tacit.sources import FactorModel, implicit, load_model, read_feedback, save_model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A pair counts once in these fits, so denominators stay positive at every scale.
PAIRS_ONCE = FitOptions(k=2, on_duplicate="distinct")


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts they ordered: ``(user_id, item_id, l_orderkey, l_linenumber)``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        "l_orderkey",
        "l_linenumber",
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases between densely indexed users and items, stored once."""
    raw = materialize(purchases(spark, sf_dir).select("user_id", "item_id"), "purchases")
    users = dense_index(raw, "user_id")
    items = dense_index(raw, "item_id")
    return materialize(
        apply_index(implicit(raw, "user_id", "item_id"), users, items, "user_id", "item_id"),
        "interactions",
    )


def big(col: str) -> Column:
    return F.col(col).cast("bigint").alias(col)


def rounded(col: str, digits: int = 9) -> Column:
    return (F.round(F.col(col).cast("double"), digits) + F.lit(0.0)).alias(col)


def long_factors(factors: DataFrame, col: str, digits: int = 6) -> DataFrame:
    return factors.select(
        F.col(col).cast("bigint").alias("idx"), F.posexplode("factors").alias("f", "value")
    ).select("idx", big("f"), rounded("value", digits))


def long_model(model: FactorModel) -> DataFrame:
    users = long_factors(model.users, "user_idx").select(F.lit("user").alias("side"), "*")
    items = long_factors(model.items, "item_idx").select(F.lit("item").alias("side"), "*")
    return users.unionByName(items)


# --- sources and projections -------------------------------------------------------------


@registered
def implicit_interactions(spark, sf_dir):
    made = implicit(purchases(spark, sf_dir), "user_id", "item_id")
    return made.select("user_id", "item_id", F.col("rating").cast("double").alias("rating"))


@registered
def events_interactions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id")
    )
    made = implicit(events, "user_id", "item_id")
    return made.select("user_id", "item_id", F.col("rating").cast("double").alias("rating"))


@registered
def json_feedback_scan(spark, sf_dir):
    """Purchases written as JSON lines with extra fields and read back by the source."""
    path = scratch_path(spark, "feedback")
    purchases(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("business_id"),
        F.concat_ws(" ", F.lit("order"), "l_orderkey").alias("text"),
    ).write.json(path)
    return implicit(read_feedback(spark, path)).select(
        "user_id", "business_id", F.col("rating").cast("double").alias("rating")
    )


# --- filters -----------------------------------------------------------------------------


@registered
def threshold_filter_k20(spark, sf_dir):
    raw = purchases(spark, sf_dir).select("user_id", "item_id")
    return threshold_filter(raw, "user_id", "item_id", 20)


@registered
def kcore_k20(spark, sf_dir):
    raw = materialize(purchases(spark, sf_dir).select("user_id", "item_id"), "purchases")
    return kcore(raw, "user_id", "item_id", 20)


@registered
def kcore_events_k60(spark, sf_dir):
    """Users and the values of their events: a second, denser source."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id")
    )
    return kcore(materialize(events, "events"), "user_id", "item_id", 60)


@registered
def top_n_filter_500(spark, sf_dir):
    raw = purchases(spark, sf_dir).select("user_id", "item_id")
    return top_n_filter(raw, "user_id", "item_id", 500, 500)


@registered
def top_n_filter_uncut(spark, sf_dir):
    raw = purchases(spark, sf_dir).select("user_id", "item_id")
    return top_n_filter(raw, "user_id", "item_id", None, 500)


# --- indexing and preparation ------------------------------------------------------------


@registered
def index_frequency(spark, sf_dir):
    got = dense_index(purchases(spark, sf_dir), "item_id", idx_col="item_idx")
    return got.select("item_id", big("item_idx"))


@registered
def index_first_seen(spark, sf_dir):
    seen = purchases(spark, sf_dir).withColumn(
        "at", F.col("l_orderkey") * 8 + F.col("l_linenumber")
    )
    got = dense_index(seen, "user_id", "first_seen", "at", "user_idx")
    return got.select("user_id", big("user_idx"))


@registered
def prepare_k20(spark, sf_dir):
    made = prepare(purchases(spark, sf_dir), "user_id", "item_id", 20).interactions
    return made.select(
        big("user_idx"), big("item_idx"), F.col("rating").cast("double").alias("rating")
    )


@registered
def prepare_popularity_k20(spark, sf_dir):
    made = prepare(purchases(spark, sf_dir), "user_id", "item_id", 20).popularity
    return made.select(big("item_idx"), rounded("f_i", 12))


# --- weights and histories ---------------------------------------------------------------


@registered
def popularity(spark, sf_dir):
    raw = purchases(spark, sf_dir).withColumnRenamed("item_id", "item_idx")
    return item_popularity(raw).select(big("item_idx"), rounded("f_i", 12))


@registered
def confidence_after_threshold(spark, sf_dir):
    raw = purchases(spark, sf_dir).select("user_id", "item_id")
    kept = threshold_filter(raw, "user_id", "item_id", 20)
    weights = item_confidence(item_popularity(kept, "item_id"), item_col="item_id")
    return weights.select("item_id", rounded("c_i"))


def _history(spark, sf_dir, own: str) -> DataFrame:
    made = implicit(purchases(spark, sf_dir), "user_id", "item_id").toDF(
        "user_idx", "item_idx", "rating"
    )
    text = F.transform(
        "events", lambda e: F.concat_ws(":", e["other"], e["rating"].cast("int"))
    )
    return entity_history(made, own).select(
        big(own), big("part"), F.array_join(text, ",").alias("events")
    )


@registered
def user_history(spark, sf_dir):
    return _history(spark, sf_dir, "user_idx")


@registered
def user_history_parts(spark, sf_dir):
    """Histories of more than eight rows, cut into parts."""
    made = implicit(purchases(spark, sf_dir), "user_id", "item_id").toDF(
        "user_idx", "item_idx", "rating"
    )
    parts = entity_history(made, "user_idx", part_rows=8)
    items = F.array_sort(F.flatten(F.collect_list(F.transform("events", lambda e: e["other"]))))
    return parts.groupBy("user_idx").agg(
        F.sum(F.size("events")).alias("n"), F.array_join(items, ",").alias("items")
    ).select(big("user_idx"), big("n"), "items")


@registered
def item_history(spark, sf_dir):
    return _history(spark, sf_dir, "item_idx")


# --- splits ------------------------------------------------------------------------------


@registered
def split_random_train(spark, sf_dir):
    return random_split(purchases(spark, sf_dir), ["l_orderkey", "l_linenumber"])[0].select(
        "user_id", "item_id", "l_orderkey", big("l_linenumber")
    )


@registered
def split_random_test(spark, sf_dir):
    return random_split(purchases(spark, sf_dir), ["l_orderkey", "l_linenumber"])[1].select(
        "user_id", "item_id", "l_orderkey", big("l_linenumber")
    )


def _pairs_of(df: DataFrame) -> DataFrame:
    return df.select(big("user_idx"), big("item_idx"))


@registered
def split_loo_train(spark, sf_dir):
    return _pairs_of(leave_one_out(interactions(spark, sf_dir))[0])


@registered
def split_loo_test(spark, sf_dir):
    return _pairs_of(leave_one_out(interactions(spark, sf_dir))[1])


@registered
def split_loo_500_users(spark, sf_dir):
    return _pairs_of(leave_one_out(interactions(spark, sf_dir), 500)[1])


# --- factors -----------------------------------------------------------------------------


@registered
def init_uniform(spark, sf_dir):
    made = init_factors(interactions(spark, sf_dir), "user_idx", 4)
    return long_factors(made, "user_idx", 9)


@registered
def init_normal(spark, sf_dir):
    made = init_factors(interactions(spark, sf_dir), "item_idx", 4, "normal")
    return long_factors(made, "item_idx", 6)


class Setup:
    """Indexed interactions with start factors and confidence for the update queries."""

    def __init__(self, spark, sf_dir, k=2, distribution="uniform", c0=512.0):
        self.data = interactions(spark, sf_dir)
        self.p = materialize(init_factors(self.data, "user_idx", k, distribution), "p")
        self.q = materialize(init_factors(self.data, "item_idx", k, distribution), "q")
        self.popularity = item_popularity(self.data)
        self.c = materialize(item_confidence(self.popularity, c0), "c")


def _cells(table: DataFrame) -> DataFrame:
    return table.select(big("f"), big("g"), rounded("value"))


@registered
def gram_items(spark, sf_dir):
    s = Setup(spark, sf_dir, 4)
    return _cells(gram(weighted_items(s.q, s.c), "c_i"))


@registered
def gram_users(spark, sf_dir):
    return _cells(gram(Setup(spark, sf_dir, 4).p))


@registered
def sweep_users_cold(spark, sf_dir):
    s = Setup(spark, sf_dir)
    got = sweep_users(s.data, s.q, s.c, FitOptions(k=2, start="cold", on_duplicate="distinct"))
    return long_factors(got, "user_idx")


@registered
def sweep_users_warm(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return long_factors(sweep_users(s.data, s.q, s.c, PAIRS_ONCE, s.p), "user_idx")


@registered
def sweep_items_cold(spark, sf_dir):
    s = Setup(spark, sf_dir)
    got = sweep_items(s.data, s.p, s.c, FitOptions(k=2, start="cold", on_duplicate="distinct"))
    return long_factors(got, "item_idx")


@registered
def sweep_items_warm(spark, sf_dir):
    s = Setup(spark, sf_dir)
    return long_factors(sweep_items(s.data, s.p, s.c, PAIRS_ONCE, s.q), "item_idx")


@registered
def sweep_users_bag(spark, sf_dir):
    """Every copy of a pair counts, under a total confidence that keeps c below one."""
    s = Setup(spark, sf_dir, c0=64.0)
    got = sweep_users(s.data, s.q, s.c, FitOptions(k=2, c0=64.0), s.p)
    return long_factors(got, "user_idx")


@registered
def sweep_items_weighted(spark, sf_dir):
    """Observed rows with weights of their own."""
    s = Setup(spark, sf_dir)
    weighted = s.data.withColumn("weight", F.lit(1.0) + (F.col("user_idx") % 3).cast("double"))
    return long_factors(sweep_items(weighted, s.p, s.c, PAIRS_ONCE, s.q), "item_idx")


@registered
def sweep_users_split(spark, sf_dir):
    """Six factors, with every user of more than 32 pairs split into chunks."""
    s = Setup(spark, sf_dir, 6)
    options = FitOptions(k=6, on_duplicate="distinct", chunk_pairs=32)
    return long_factors(sweep_users(s.data, s.q, s.c, options, s.p), "user_idx")


@registered
def sweep_users_k16(spark, sf_dir):
    """Sixteen factors, warm."""
    s = Setup(spark, sf_dir, 16)
    options = FitOptions(k=16, on_duplicate="distinct")
    return long_factors(sweep_users(s.data, s.q, s.c, options, s.p), "user_idx")


@registered
def als_items_k16(spark, sf_dir):
    """Exact solves with sixteen factors."""
    s = Setup(spark, sf_dir, 16, "normal")
    options = FitOptions(k=16, on_duplicate="distinct")
    return long_factors(als_items(s.data, s.p, options), "item_idx")


@registered
def sweep_items_split(spark, sf_dir):
    """Every item of more than 16 pairs split into chunks."""
    s = Setup(spark, sf_dir)
    options = FitOptions(k=2, on_duplicate="distinct", chunk_pairs=16)
    return long_factors(sweep_items(s.data, s.p, s.c, options, s.q), "item_idx")


@registered
def als_users_split(spark, sf_dir):
    """Exact solves of users whose pairs are split into chunks of 16."""
    s = Setup(spark, sf_dir, 2, "normal")
    options = FitOptions(k=2, on_duplicate="distinct", chunk_pairs=16)
    return long_factors(als_users(s.data, s.q, options), "user_idx")


@registered
def fit_two_iterations(spark, sf_dir):
    data = interactions(spark, sf_dir)
    options = FitOptions(k=2, iterations=2, on_duplicate="distinct")
    return long_model(fit(data, item_popularity(data), options))


@registered
def fit_two_iterations_keep(spark, sf_dir):
    """Every copy of a pair counts, under a total confidence that keeps c below one."""
    data = interactions(spark, sf_dir)
    return long_model(fit(data, item_popularity(data), FitOptions(k=2, iterations=2, c0=64.0)))


@registered
def fit_cold_normal(spark, sf_dir):
    data = interactions(spark, sf_dir)
    options = FitOptions(k=4, iterations=2, start="cold", init="normal", on_duplicate="distinct")
    return long_model(fit(data, item_popularity(data), options))


@registered
def als_users_solve(spark, sf_dir):
    s = Setup(spark, sf_dir, 2, "normal")
    return long_factors(als_users(s.data, s.q, PAIRS_ONCE), "user_idx")


@registered
def als_items_solve(spark, sf_dir):
    s = Setup(spark, sf_dir, 2, "normal")
    return long_factors(als_items(s.data, s.p, PAIRS_ONCE), "item_idx")


@registered
def als_fit_two_iterations(spark, sf_dir):
    options = FitOptions(k=2, iterations=2, init="normal", on_duplicate="distinct")
    return long_model(fit_uniform(interactions(spark, sf_dir), options))


@registered
def als_fit_idle_entities(spark, sf_dir):
    """A thin part of the pairs, fitted for all users and items: the idle ones keep their start."""
    data = interactions(spark, sf_dir)
    options = FitOptions(k=2, iterations=2, init="normal", on_duplicate="distinct")
    thin = materialize(_thin_train(data), "thin")
    return long_model(fit_uniform(thin, options, users=data, items=data))


@registered
def model_roundtrip(spark, sf_dir):
    """A model saved with its id maps and read back, its vectors listed by raw ids."""
    raw = materialize(purchases(spark, sf_dir).select("user_id", "item_id"), "purchases")
    users = dense_index(raw, "user_id", idx_col="user_idx")
    items = dense_index(raw, "item_id", idx_col="item_idx")
    data = materialize(
        apply_index(implicit(raw, "user_id", "item_id"), users, items, "user_id", "item_id"),
        "interactions",
    )
    options = FitOptions(k=2, iterations=1, on_duplicate="distinct")
    path = scratch_path(spark, "model")
    save_model(
        replace(fit(data, item_popularity(data), options), user_ids=users, item_ids=items), path
    )
    model = load_model(spark, path)
    sides = [
        long_factors(model.users.join(model.user_ids, "user_idx"), "user_id").select(
            F.lit("user").alias("side"), "*"
        ),
        long_factors(model.items.join(model.item_ids, "item_idx"), "item_id").select(
            F.lit("item").alias("side"), "*"
        ),
    ]
    return sides[0].unionByName(sides[1])


# --- evaluation --------------------------------------------------------------------------


class Trial:
    """A split, by default leave-one-out of all users, and a small model of its train part."""

    def __init__(self, spark, sf_dir, split=leave_one_out):
        train, test = split(interactions(spark, sf_dir))
        self.test = materialize(test, "test")
        self.train = materialize(train, "train")
        self.options = FitOptions(k=2, iterations=1, on_duplicate="distinct")
        self.popularity = item_popularity(self.train)

    def model(self) -> FactorModel:
        return fit(self.train, self.popularity, self.options)

    def scored(self, mode="uniform") -> DataFrame:
        model = self.model()
        seen = self.train if mode == "unseen" else None
        candidates = negative_candidates(self.test, model.items, mode=mode, seen=seen)
        return score_pairs(candidates, model.users, model.items)


@registered
def scored_pairs(spark, sf_dir):
    trial = Trial(spark, sf_dir)
    model = trial.model()
    got = score_pairs(trial.test.select("user_idx", "item_idx"), model.users, model.items)
    return got.select(big("user_idx"), big("item_idx"), rounded("score"))


@registered
def scored_pairs_k32(spark, sf_dir):
    """Scores of start vectors with 32 elements, which take the batched product."""
    s = Setup(spark, sf_dir, 32)
    got = score_pairs(s.data.select("user_idx", "item_idx").distinct(), s.p, s.q)
    return got.select(big("user_idx"), big("item_idx"), rounded("score"))


def _candidates(spark, sf_dir, mode: str) -> DataFrame:
    trial = Trial(spark, sf_dir)
    got = negative_candidates(trial.test, trial.train, mode=mode, seen=trial.train)
    return got.select(big("user_idx"), big("item_idx"), big("is_true"))


@registered
def negatives_uniform(spark, sf_dir):
    return _candidates(spark, sf_dir, "uniform")


@registered
def negatives_unseen(spark, sf_dir):
    return _candidates(spark, sf_dir, "unseen")


@registered
def ranked_candidates(spark, sf_dir):
    got = rank_candidates(Trial(spark, sf_dir).scored())
    return got.select(big("user_idx"), big("item_idx"), big("is_true"), big("rank"))


@registered
def scored_pairs_cells(spark, sf_dir):
    """The path of tables that are too large for a broadcast, with several blocks and chunks."""
    s = Setup(spark, sf_dir, 32)
    pairs = s.data.select("user_idx", "item_idx").distinct()
    got = score_pairs(pairs, s.p, s.q, broadcast_bytes=0, block_bytes=100_000)
    return got.select(big("user_idx"), big("item_idx"), rounded("score"))


def _metrics(trial: Trial, mode: str = "uniform", **sizes) -> DataFrame:
    model = trial.model()
    seen = trial.train if mode == "unseen" else None
    ranks = rank_drawn(trial.test, model.users, model.items, mode=mode, seen=seen, **sizes)
    return _figures(trial, ranks)


def _figures(trial: Trial, ranks: DataFrame) -> DataFrame:
    return ranking_metrics(trial.test, ranks).select(
        "n_test",
        "n_covered",
        "min_candidates",
        rounded("mean_candidates"),
        rounded("hit_ratio"),
        rounded("ndcg"),
    )


@registered
def hit_ndcg_uniform(spark, sf_dir):
    return _metrics(Trial(spark, sf_dir))


@registered
def hit_ndcg_scored(spark, sf_dir):
    """Ranks counted on candidates that were scored one by one."""
    trial = Trial(spark, sf_dir)
    return _figures(trial, case_ranks(trial.scored()))


@registered
def hit_ndcg_cells(spark, sf_dir):
    """Ranks of factor tables that are too large for a broadcast or a single block."""
    return _metrics(Trial(spark, sf_dir), broadcast_bytes=0, block_bytes=8_000)


@registered
def hit_ndcg_unseen(spark, sf_dir):
    return _metrics(Trial(spark, sf_dir), "unseen")


def _by_pair(fraction: float):
    return lambda data: random_split(data, ["user_idx", "item_idx"], fraction)


@registered
def hit_ndcg_sparse_train(spark, sf_dir):
    """A thin train part, whose items leave gaps between their ids: candidates stay complete."""
    return _metrics(Trial(spark, sf_dir, _by_pair(0.02)))


@registered
def hit_ndcg_many_per_user(spark, sf_dir):
    """Several test rows per user, each ranked among its own candidates."""
    return _metrics(Trial(spark, sf_dir, _by_pair(0.8)))


def _thin_train(data: DataFrame) -> DataFrame:
    """A random tenth of the pairs, which leaves some users and items unknown."""
    return random_split(data, ["user_idx", "item_idx"], 0.1)[0]


@registered
def complete_factor_table(spark, sf_dir):
    """Item vectors from a thin train part, with start vectors for the items it lacks."""
    data = interactions(spark, sf_dir)
    train = _thin_train(data)
    options = FitOptions(k=2, iterations=1, c0=64.0, on_duplicate="distinct")
    model = fit(train, item_popularity(train), options)
    return long_factors(complete_factors(data, model.items, "item_idx", 2), "item_idx")


@registered
def complete_confidence_table(spark, sf_dir):
    data = interactions(spark, sf_dir)
    weights = item_confidence(item_popularity(_thin_train(data)))
    return complete_confidence(data, weights).select(big("item_idx"), rounded("c_i"))


@registered
def rmse_coverage(spark, sf_dir):
    """Random split by pair; test pairs of entities without factors lower the coverage."""
    data = interactions(spark, sf_dir)
    train, test = random_split(data, ["user_idx", "item_idx"], 0.8)
    # Popularity, pairs, scores and counts read them: rows are drawn once.
    train, test = materialize(train, "train"), materialize(test, "test")
    options = FitOptions(k=2, iterations=1, on_duplicate="distinct")
    model = fit(train, item_popularity(train), options)
    return prediction_error(test, model.users, model.items).select(
        "n_test", "n_covered", rounded("coverage"), rounded("rmse")
    )


@registered
def telemetry_ops(spark, sf_dir):
    return operation_counts(interactions(spark, sf_dir), 64).select(
        "n_users",
        "n_items",
        rounded("mops_elementwise", 6),
        rounded("mops_exact", 6),
        "gain_factor",
        rounded("mops_observed", 6),
    )


@registered
def telemetry(spark, sf_dir):
    """Preparation, split, fit and evaluation in one run; a row per iteration."""
    prepared = prepare(purchases(spark, sf_dir), "user_id", "item_id", 10)
    train, test = leave_one_out(prepared.interactions)
    train, test = materialize(train, "train"), materialize(test, "test")
    options = FitOptions(k=2, iterations=2, on_duplicate="distinct")
    report = fit_with_telemetry(train, test, prepared.popularity, options)[1]
    return report.select(
        "iteration",
        "n_users",
        "n_items",
        "n_test",
        "n_covered",
        rounded("mean_candidates"),
        rounded("hit_ratio"),
        rounded("ndcg"),
        rounded("rmse"),
        rounded("mops_elementwise", 6),
    )
