"""Factorisation loops: alternate the two half-steps over stored factor tables.

The driver holds the loop, row counts and one K x K matrix per half-step; everything else stays
on the executors.  Each half-step writes its factor table to the shared folder, which cuts the
lineage, and drops the table it replaces.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tacit.operators.evaluation import evaluate, negative_lists, prediction_error
from tacit.operators.factors import cache_matrix, init_factors, weighted_items
from tacit.operators.layout import (
    Layout,
    build_layout,
    default_block_pairs,
    pair_table,
    with_confidence,
)
from tacit.operators.updates import State, Update, step
from tacit.operators.weights import item_confidence
from tacit.scratch import Stored, materialize, release, scope, store
from tacit.sources.models import FactorModel
from tacit.versions import Versions


@dataclass(frozen=True)
class FitOptions:
    """Hyperparameters and physical choices of a fit.

    ``start``: "warm" sweeps begin at the current vectors and never raise the objective; "cold"
    ones begin at zero.  ``storage``: element type of factor tables; arithmetic is double.
    ``block_pairs`` and ``chunk_pairs`` bound the pairs per task group and per unsplit entity.
    """

    k: int = 128
    lam: float = 0.01
    c0: float = 512.0
    alpha: float = 0.4
    iterations: int = 10
    start: str = "warm"
    init: str = "uniform"
    seed: int = 42
    on_duplicate: str = "keep"
    storage: str = "float"
    block_pairs: int | None = None
    chunk_pairs: int | None = None

    def update(self, method: str = "sweep") -> Update:
        if self.start not in ("warm", "cold"):
            raise ValueError(f"unknown start {self.start!r}")
        return Update(self.k, self.lam, method, self.start, self.storage)


class FitLog:
    """Finished half-steps of a fit, in a folder that all executors share.

    A half-step's table is written there and then named by a manifest, so a fit that was stopped
    goes on behind the last one named.  Tables that no later half-step needs are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.settings = spark, settings
        self.folder = Versions(spark, path)
        self.state = self.folder.newest() or {"settings": settings, "done": 0, "tables": {}}
        if self.state["settings"] != settings:
            raise ValueError(f"{path} holds the log of another fit")

    @property
    def done(self) -> int:
        """Half-steps that need not run again."""
        return self.state["done"]

    def table(self, side: str) -> DataFrame | None:
        part = self.state["tables"].get(side)
        return self.spark.read.parquet(f"{self.folder.path}/{part}") if part else None

    def record(self, side: str, table: DataFrame) -> None:
        part = f"{side}-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder.path}/{part}")
        tables = self.state["tables"] | {side: part}
        self.state = {
            "settings": self.settings,
            "done": self.done + 1,
            "tables": tables,
            "parts": sorted(tables.values()),
        }
        self.folder.commit(self.state)
        self.folder.tidy()


class Placement:
    """Stored pairs and the layouts derived from them."""

    def __init__(self, interactions: DataFrame, confidence: DataFrame | float, o: FitOptions):
        self.options = o
        self.pairs: Stored = store(
            with_confidence(pair_table(interactions, o.on_duplicate), confidence), "pairs"
        )
        self.layouts: dict[str, Layout] = {}

    def side(self, name: str) -> Layout:
        if name not in self.layouts:
            o = self.options
            self.layouts[name] = build_layout(
                self.pairs.frame,
                self.pairs.rows,
                name,
                o.block_pairs or default_block_pairs(o.k, o.storage),
                o.chunk_pairs,
            )
        return self.layouts[name]

    def release(self) -> None:
        for layout in self.layouts.values():
            layout.release()
        self.pairs.drop()


def _one_step(
    side: str,
    interactions: DataFrame,
    counterpart: DataFrame,
    own: DataFrame | None,
    confidence: DataFrame | float,
    options: FitOptions,
    method: str,
) -> DataFrame:
    placement = Placement(interactions, confidence, options)
    try:
        state = step(placement.side(side), counterpart, own, options.update(method))
        return state.frame.select(f"{side}_idx", "factors")
    finally:
        placement.release()


def _options(factors: DataFrame, given: FitOptions) -> FitOptions:
    width = factors.select(F.size("factors")).first()
    if width is None or width[0] != given.k:
        raise ValueError(f"factors do not have k={given.k} elements")
    return given


def sweep_users(
    interactions: DataFrame,
    items: DataFrame,
    confidence: DataFrame,
    options: FitOptions,
    users: DataFrame | None = None,
) -> DataFrame:
    """One element-wise pass over all users; ``users`` gives the start of a warm pass."""
    return _one_step(
        "user",
        interactions,
        weighted_items(items, confidence),
        users,
        confidence,
        _options(items, options),
        "sweep",
    )


def sweep_items(
    interactions: DataFrame,
    users: DataFrame,
    confidence: DataFrame,
    options: FitOptions,
    items: DataFrame | None = None,
) -> DataFrame:
    """One element-wise pass over all items; ``items`` gives the start of a warm pass."""
    return _one_step(
        "item", interactions, users, items, confidence, _options(users, options), "sweep"
    )


def als_users(
    interactions: DataFrame, items: DataFrame, options: FitOptions, w0: float = 0.01
) -> DataFrame:
    """Exact user vectors under the same weight ``w0`` for all missing feedback."""
    weighted = items.withColumn("c_i", F.lit(float(w0)))
    return _one_step("user", interactions, weighted, None, w0, _options(items, options), "solve")


def als_items(
    interactions: DataFrame, users: DataFrame, options: FitOptions, w0: float = 0.01
) -> DataFrame:
    """Exact item vectors under the same weight ``w0`` for all missing feedback."""
    return _one_step("item", interactions, users, None, w0, _options(users, options), "solve")


def _alternate(
    placement: Placement,
    users: DataFrame,
    items: DataFrame,
    method: str,
    keep: tuple[DataFrame, DataFrame] | None = None,
    on_iteration: Callable[[int, float, DataFrame, DataFrame], None] | None = None,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run the iterations.  ``keep`` holds fixed vectors of entities without any pair."""
    options = placement.options
    how = options.update(method)
    parts: dict[str, State] = {}
    idle = {"user": 0.0, "item": 0.0}
    if keep is not None:
        idle["user"] = cache_matrix(keep[0], None, how.k)
        idle["item"] = cache_matrix(keep[1], "c_i", how.k)

    def advance(side: str, counterpart: DataFrame, own: DataFrame) -> DataFrame:
        facing = "item" if side == "user" else "user"
        cache = parts[facing].cache(how.k) + idle[facing] if facing in parts else None
        fresh = step(placement.side(side), counterpart, own, how, cache)
        if side in parts:
            parts[side].drop()
        parts[side] = fresh
        if book is not None:
            book.record(side, fresh.frame)
        return whole(side, fresh.frame)

    def whole(side: str, table: DataFrame) -> DataFrame:
        if keep is None:
            return table
        return table.unionByName(keep[0] if side == "user" else keep[1])

    book = None
    if log is not None:
        settings = {"method": method, "pairs": placement.pairs.rows, **asdict(options)}
        del settings["iterations"]  # a fit may be prolonged
        book = FitLog(placement.pairs.frame.sparkSession, log, settings)
        known = {side: book.table(side) for side in ("user", "item")}
        users = users if known["user"] is None else whole("user", known["user"])
        items = items if known["item"] is None else whole("item", known["item"])
    done = book.done if book else 0
    if done > 2 * options.iterations:
        raise ValueError("the log holds more iterations than were asked for")
    for iteration in range(done // 2 + 1, options.iterations + 1):
        started = time.monotonic()
        if done < 2 * iteration - 1:
            users = advance("user", items, users)
        items = advance("item", users, items)
        if on_iteration is not None:
            on_iteration(iteration, time.monotonic() - started, users, items)
    return users, items


def fit(
    interactions: DataFrame,
    popularity: DataFrame,
    options: FitOptions = FitOptions(),
    on_iteration: Callable[[int, float, FactorModel], None] | None = None,
    log: str | None = None,
) -> FactorModel:
    """Popularity-weighted factorisation by element-wise alternating least squares.

    ``on_iteration`` receives iteration, seconds and model; that model's tables are replaced by
    the next iteration, so it must use them before it returns.  Of the tables written on the way
    only those of the model stay.

    With ``log``, a folder of the shared file system, finished half-steps are kept there: called
    again with the same data and options, a fit that was stopped goes on where it was.  A log of
    other options or data is an error; more iterations prolong the fit.
    """
    with scope() as made:
        model = _fit(interactions, popularity, options, on_iteration, log)
    release(made, model.users, model.items)
    return model


def _fit(interactions, popularity, options, on_iteration, log) -> FactorModel:
    confidence = store(item_confidence(popularity, options.c0, options.alpha), "confidence").frame
    placement = Placement(interactions, confidence, options)
    try:
        pairs = placement.pairs.frame
        start = {
            col: store(
                init_factors(pairs, col, options.k, options.init, options.seed, options.storage),
                f"{col}-start",
            )
            for col in ("user_idx", "item_idx")
        }
        report = None
        if on_iteration is not None:
            def report(iteration, seconds, users, items):
                on_iteration(iteration, seconds, _model(users, items))
        users, items = _alternate(
            placement,
            start["user_idx"].frame,
            weighted_items(start["item_idx"].frame, confidence),
            "sweep",
            on_iteration=report,
            log=log,
        )
        return _model(users, items)
    finally:
        placement.release()


def _model(users: DataFrame, items: DataFrame) -> FactorModel:
    return FactorModel(users, items.select("item_idx", "factors"))


def fit_uniform(
    interactions: DataFrame,
    options: FitOptions = FitOptions(k=16, iterations=7, init="normal", on_duplicate="distinct"),
    w0: float = 0.01,
    users: DataFrame | None = None,
    items: DataFrame | None = None,
    log: str | None = None,
) -> FactorModel:
    """Factorisation with one weight ``w0`` for all missing feedback and exact solves.

    ``users`` and ``items`` may list more ids than the interactions hold; those keep their
    initial vectors.  Of the tables written on the way only those of the model stay.  ``log``
    makes the fit resumable, as in :func:`fit`.
    """
    with scope() as made:
        model = _fit_uniform(interactions, options, w0, users, items, log)
    release(made, model.users, model.items)
    return model


def _fit_uniform(interactions, options, w0, users, items, log) -> FactorModel:
    placement = Placement(interactions, w0, options)
    try:
        pairs = placement.pairs.frame

        def begin(entities: DataFrame | None, col: str) -> DataFrame:
            made = init_factors(
                pairs if entities is None else entities,
                col,
                options.k,
                options.init,
                options.seed,
                options.storage,
            )
            return store(made, f"{col}-start").frame

        p = begin(users, "user_idx")
        q = begin(items, "item_idx").withColumn("c_i", F.lit(float(w0)))
        keep = None
        if users is not None or items is not None:
            idle_users = p.join(pairs.select("user_idx").distinct(), "user_idx", "left_anti")
            idle_items = q.join(pairs.select("item_idx").distinct(), "item_idx", "left_anti")
            keep = (
                store(idle_users, "idle-users").frame,
                store(idle_items, "idle-items").frame.select("item_idx", "c_i", "factors"),
            )
        p, q = _alternate(placement, p, q, "solve", keep, log=log)
        return _model(p, q)
    finally:
        placement.release()


TELEMETRY = T.StructType(
    [
        T.StructField("iteration", T.LongType()),
        T.StructField("n_users", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("n_test", T.LongType()),
        T.StructField("n_covered", T.LongType()),
        T.StructField("mean_candidates", T.DoubleType()),
        T.StructField("hit_ratio", T.DoubleType()),
        T.StructField("ndcg", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mops_elementwise", T.DoubleType()),
        T.StructField("mops_exact", T.DoubleType()),
        T.StructField("gain_factor", T.DoubleType()),
        T.StructField("mops_observed", T.DoubleType()),
    ]
)


def operation_counts(interactions: DataFrame, k: int) -> DataFrame:
    """One row of cost-model figures, in millions of operations per iteration.

    ``mops_elementwise`` and ``mops_exact`` count (users + items) * K**2 and K**3;
    ``mops_observed`` is the rows * K term that both leave out.
    """
    kk = float(k)
    both = (F.col("n_users") + F.col("n_items")).cast("double")
    users = interactions.select("user_idx").distinct().agg(F.count(F.lit(1))).scalar()
    items = interactions.select("item_idx").distinct().agg(F.count(F.lit(1))).scalar()
    return (
        interactions.agg(F.count(F.lit(1)).alias("rows"))
        .select("rows", users.alias("n_users"), items.alias("n_items"))
        .select(
            "n_users",
            "n_items",
            (both * F.lit(kk**2) / F.lit(1e6)).alias("mops_elementwise"),
            (both * F.lit(kk**3) / F.lit(1e6)).alias("mops_exact"),
            F.lit(kk).alias("gain_factor"),
            (F.col("rows").cast("double") * F.lit(kk) / F.lit(1e6)).alias("mops_observed"),
        )
    )


def fit_with_telemetry(
    train: DataFrame,
    test: DataFrame,
    popularity: DataFrame,
    options: FitOptions = FitOptions(),
    n_negatives: int = 99,
    top: int = 10,
    mode: str = "uniform",
) -> tuple[FactorModel, DataFrame]:
    """:func:`fit`, with ranking quality, error and cost figures for every iteration.

    Candidates are drawn once, from the train items, all of which get vectors.
    """
    with scope() as made:
        model, report = _fit_with_telemetry(
            train, test, popularity, options, n_negatives, top, mode
        )
    release(made, model.users, model.items)
    return model, report


def _fit_with_telemetry(train, test, popularity, options, n_negatives, top, mode):
    spark = train.sparkSession
    cost = operation_counts(train, options.k).first()
    seen = train if mode == "unseen" else None
    candidates = materialize(
        negative_lists(test, train, n_negatives, options.seed, mode, seen), "candidates"
    )
    rows = []

    def record(iteration: int, seconds: float, model: FactorModel) -> None:
        quality = evaluate(
            test, model.users, model.items, k=top, candidates=candidates
        ).first()
        error = prediction_error(test, model.users, model.items).first()
        rows.append(
            (
                iteration,
                cost.n_users,
                cost.n_items,
                seconds,
                quality.n_test,
                quality.n_covered,
                quality.mean_candidates,
                quality.hit_ratio,
                quality.ndcg,
                error.rmse,
                cost.mops_elementwise,
                cost.mops_exact,
                cost.gain_factor,
                cost.mops_observed,
            )
        )

    model = fit(train, popularity, options, record)
    return model, spark.createDataFrame(rows, TELEMETRY)
