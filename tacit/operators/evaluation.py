"""Scoring, candidate sampling, ranking metrics and prediction error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tacit.functions import draw, draw_below
from tacit.operators.drawn import rank_draws
from tacit.operators.indexing import dense_index
from tacit.operators.scoring import (
    BLOCK_BYTES,
    BROADCAST_BYTES,
    element_bytes,
    fits_broadcast,
    rank_lists,
    score_pairs,
    table_sizes,
    true_scores,
)
from tacit.scratch import materialize, spread, store, task_width

# First round of unseen-item draws per wanted negative, and growth of later rounds.
DRAWS_PER_NEGATIVE = 1.25
DRAWS_GROWTH = 4
# Numbers that one row is expanded to at a time, and the most that a row may draw in vain.
NUMBER_SPAN = 100_000
# Negatives in one row of a list.
LIST_SPAN = 10_000
# Seen items in one packed row of a user.
SEEN_SPAN = 100_000


def negative_candidates(
    test: DataFrame,
    items: DataFrame,
    n: int = 99,
    seed: int = 42,
    mode: str = "uniform",
    seen: DataFrame | None = None,
) -> DataFrame:
    """``(user_idx, true_item, item_idx, is_true)``: each test pair plus ``n`` items of ``items``.

    The rows of :func:`negative_lists`, one by one, and those of the test pairs.
    """
    truth = _cases(test).select(
        "user_idx",
        "true_item",
        F.col("true_item").cast("int").alias("item_idx"),
        F.lit(1).cast("bigint").alias("is_true"),
    )
    lists = negative_lists(test, items, n, seed, mode, seen)
    false = lists.select("user_idx", "true_item", F.explode("negatives").alias("item_idx"))
    return truth.unionByName(false.withColumn("is_true", F.lit(0).cast("bigint")))


def _cases(test: DataFrame) -> DataFrame:
    return test.select("user_idx", F.col("item_idx").alias("true_item")).distinct()


def negative_lists(
    test: DataFrame,
    items: DataFrame,
    n: int = 99,
    seed: int = 42,
    mode: str = "uniform",
    seen: DataFrame | None = None,
) -> DataFrame:
    """``(user_idx, true_item, negatives)``: ``n`` items of ``items`` for each test pair.

    A case is a distinct (user, item) pair of ``test``.  Items are drawn by their position among
    the ids of ``items``, usually the items that have a vector, so gaps between ids cost nothing.
    ``uniform``: draws with replacement; they may repeat or hit the true or a seen item.
    ``unseen``: distinct items outside ``seen`` (user_idx, item_idx) and other than the true
    one, in draw order; a user with fewer than ``n`` unseen items gets all of them.  Every case
    has a row, or several where ``n`` is large; a list may be empty.
    """
    places = Places(items)
    if mode == "uniform":
        lists = _uniform(materialize(_cases(test), "cases"), places, n, seed)
        return places.named(lists, "_low").select("user_idx", "true_item", "negatives")
    if mode == "unseen":
        if seen is None:
            raise ValueError("unseen negatives need the seen pairs")
        return _unseen(_cases(test), places, n, seed, seen)
    raise ValueError(f"unknown mode {mode!r}")


def _uniform(cases: DataFrame, places: Places, n: int, seed: int) -> DataFrame:
    """Stored ``cases`` with ``_low`` and ``places``, the draws from number ``_low`` on."""
    low = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1), F.lit(LIST_SPAN)))
    high = F.least(F.col("_low") + LIST_SPAN, F.lit(n)) - 1
    numbers = F.sequence(F.col("_low"), high) if n and places.rows else F.array().cast("array<int>")
    drawn = F.transform(numbers, lambda j: _draw_place(places.rows, j, seed))
    cases = spread(cases, "user_idx", "true_item")
    return cases.select("*", low.alias("_low")).withColumn("places", drawn)


def rank_drawn(
    test: DataFrame,
    users: DataFrame,
    items: DataFrame,
    n: int = 99,
    seed: int = 42,
    mode: str = "uniform",
    seen: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """:func:`rank_lists` of the lists that :func:`negative_lists` draws from ``items``.

    Only cases whose true item has a score are drawn for.  Uniform draws are made where they are
    scored, by :func:`~tacit.operators.drawn.rank_draws`; ``block_bytes`` of item vectors are
    worked on at a time.
    """
    if mode != "uniform":
        lists = negative_lists(test, items, n, seed, mode, seen)
        return rank_lists(_cases(test), lists, users, items, broadcast_bytes, block_bytes)
    cases = store(true_scores(_cases(test), users, items, broadcast_bytes, block_bytes), "cases")
    places = Places(items)
    n_users, _, width = table_sizes(users, items)
    vectors = users.select("user_idx", F.col("factors").alias("_vector"))
    small = fits_broadcast(n_users, width, broadcast_bytes)
    posed = cases.frame.join(F.broadcast(vectors) if small else vectors.hint("merge"), "user_idx")
    placed = places.of_items(items.select("item_idx", "factors"), "item_idx")
    counts = rank_draws(
        posed, cases.rows, placed, places.rows, places.same, width, element_bytes(users, items), n, seed, block_bytes
    )
    return (
        counts.groupBy("user_idx", "true_item")
        .agg((F.sum("before") + 1).alias("rank"), F.sum("n").alias("n_candidates"))
        .select("user_idx", F.col("true_item").alias("item_idx"), "rank", "n_candidates")
    )


class Places:
    """The ids of a frame's items, numbered from 0 in ascending order."""

    def __init__(self, items: DataFrame):
        ids = items.select("item_idx").distinct()
        made = store(dense_index(ids, "item_idx", "first_seen", "item_idx", "place"), "places")
        self.rows = made.rows
        self.frame = made.frame.select("place", F.col("item_idx").cast("int").alias("item_idx"))
        least, most = made.frame.agg(F.min("item_idx"), F.max("item_idx")).first()
        # Ids without gaps are their own places.
        self.same = least == 0 and most == made.rows - 1
        self.table = F.broadcast(self.frame) if fits_broadcast(made.rows, 1) else self.frame.hint("merge")

    def of_items(self, df: DataFrame, col: str) -> DataFrame:
        """Add ``place`` to rows with an item id; rows of other items get null."""
        if self.same:
            inside = (F.col(col) >= 0) & (F.col(col) < self.rows)
            return df.withColumn("place", F.when(inside, F.col(col).cast("int")))
        table = self.table.withColumnRenamed("item_idx", col)
        return df.join(table, col, "left")

    def named(self, lists: DataFrame, *key: str) -> DataFrame:
        """``negatives`` in the place of ``places``, per case (and further key columns)."""
        if self.same:
            return lists.withColumnRenamed("places", "negatives")
        columns = ["user_idx", "true_item", *key]
        one = lists.select(*columns, F.posexplode_outer("places").alias("_at", "place"))
        item = F.when(F.col("item_idx").isNotNull(), F.struct("_at", "item_idx"))
        found = one.join(self.table, "place", "left").groupBy(*columns)
        return found.agg(F.sort_array(F.collect_list(item)).alias("_l")).select(
            *columns, F.transform("_l", lambda x: x["item_idx"]).alias("negatives")
        )


def _draw_place(count: int, j: Column, seed: int) -> Column:
    place = draw_below(F.lit(count), F.col("user_idx"), F.col("true_item"), j, seed=seed)
    return place.cast("int")


def _packed(seen: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(user_idx, seen)``: sorted arrays of places; users with long ones apart, in several rows."""
    counts = store(seen.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SEEN_SPAN), "long")
    short = seen
    if counts.rows:
        short = seen.join(F.broadcast(counts.frame), "user_idx", "left_anti")
    packed = short.groupBy("user_idx").agg(F.sort_array(F.collect_list("place")).alias("seen"))
    packed = materialize(packed, "seen-packed")
    if not counts.rows:
        return packed, None
    part = F.pmod(F.xxhash64("place"), F.ceil(F.col("_n") / SEEN_SPAN))
    long = seen.join(F.broadcast(counts.frame), "user_idx").groupBy("user_idx", part.alias("_part"))
    long = long.agg(F.sort_array(F.collect_list("place")).alias("seen")).drop("_part")
    return packed, materialize(long, "seen-packed")


def _unseen(cases: DataFrame, places: Places, n: int, seed: int, seen: DataFrame) -> DataFrame:
    """Rejection sampling inside the row in growing rounds, then what the few users left have not seen.

    The seen items of a user travel once, packed; draws are made, and dropped, in the row of
    their case.  A case still short after about as many draws as there are items, or as a row
    may hold, belongs to a user who has seen nearly all of them.  Such a user's unseen items are
    few; they are found once per user and shared by the user's cases, each of which takes them in
    the order of a draw of its own.
    """
    key = ["user_idx", "true_item"]
    todo = places.of_items(cases, "true_item").select(*key, F.col("place").alias("_true"))
    todo = materialize(todo, "cases")
    rows = seen.join(todo.select("user_idx").distinct(), "user_idx", "left_semi")
    rows = places.of_items(rows.select("user_idx", F.col("item_idx").cast("int").alias("item_idx")), "item_idx")
    # Pairs are nearly distinct, so counting before the shuffle would hold a split of them.
    rows = rows.where(F.col("place").isNotNull()).select("user_idx", "place")
    rows = rows.repartition(task_width(seen.sparkSession), "user_idx", "place").distinct()
    rows = materialize(rows, "seen")
    packed, long = _packed(rows)
    done = None
    n_draws = math.ceil(DRAWS_PER_NEGATIVE * n)
    most = max(NUMBER_SPAN, n_draws)
    while n_draws < places.rows and n_draws <= most:
        numbers = F.sequence(F.lit(0), F.lit(n_draws - 1)) if n_draws else F.array().cast("array<int>")
        drawn = F.array_distinct(F.transform(numbers, lambda j: _draw_place(places.rows, j, seed)))
        fresh = F.array_except(drawn, F.array("_true"))
        none = F.array().cast("array<int>")
        # Cases are few bytes and much work: all tasks take part.
        posed = spread(todo, *key).join(packed, "user_idx", "left")
        got = posed.select(*key, "_true", F.array_except(fresh, F.coalesce("seen", none)).alias("places"))
        if long is not None:
            hits = todo.join(long, "user_idx").select(*key, F.array_intersect(fresh, F.col("seen")).alias("hit"))
            hits = hits.groupBy(*key).agg(F.flatten(F.collect_list("hit")).alias("hit"))
            rest = F.array_except("places", F.coalesce("hit", none))
            got = got.join(hits, key, "left").select(*key, "_true", rest.alias("places"))
        got = store(got.withColumn("places", F.slice("places", 1, n) if n else none), "unseen").frame
        full = F.size("places") >= n
        enough = got.where(full).select(*key, "places")
        done = enough if done is None else done.unionByName(enough)
        short = store(got.where(~full).select(*key, "_true"), "cases")
        if not short.rows:
            return places.named(done).select(*key, "negatives")
        todo, n_draws = short.frame, n_draws * DRAWS_GROWTH
    every = todo.select("user_idx").distinct()
    low = F.explode(F.sequence(F.lit(0), F.lit(max(places.rows, 1) - 1), F.lit(NUMBER_SPAN)))
    spans = spread(every.select("user_idx", low.alias("_low")), "user_idx", "_low")
    high = F.least(F.col("_low") + NUMBER_SPAN, F.lit(places.rows)) - 1
    numbers = F.sequence(F.col("_low"), high) if places.rows else F.array().cast("array<int>")
    left = spans.select("user_idx", F.explode(numbers).alias("place")).join(rows, ["user_idx", "place"], "left_anti")
    unseen = materialize(left.join(places.table, "place").select("user_idx", "item_idx"), "unseen-rest")
    order = draw(F.col("user_idx"), F.col("true_item"), F.col("item_idx"), "rest", seed=seed)
    listed = todo.select(*key).join(unseen, "user_idx").where(F.col("item_idx") != F.col("true_item"))
    last = _first(listed.withColumn("j", order), n).groupBy(*key)
    last = last.agg(F.sort_array(F.collect_list(F.struct("j", "item_idx"))).alias("_l"))
    last = todo.select(*key).join(last, key, "left").select(
        *key,
        F.coalesce(F.transform("_l", lambda x: x["item_idx"]), F.array().cast("array<int>")).alias("negatives"),
    )
    return last if done is None else places.named(done).select(*key, "negatives").unionByName(last)


def _first(pool: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows per case by ``j``; a case holds what its user has not seen."""
    order = Window.partitionBy("user_idx", "true_item").orderBy("j", "item_idx")
    return pool.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_at")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Rank within a case by score; ties go to the lower item, then to the true row.

    The group of a case is its candidate list, whose length is the sample size plus one.
    """
    order = Window.partitionBy("user_idx", "true_item").orderBy(
        F.desc("score"), F.asc("item_idx"), F.desc("is_true")
    )
    return scored.withColumn("rank", F.row_number().over(order))


def case_ranks(scored: DataFrame) -> DataFrame:
    """``(user_idx, item_idx, rank, n_candidates)`` per case whose true item has a score.

    The rank of a true row is one more than the number of its case's candidates that come before
    it in the order of :func:`rank_candidates`.  For candidates already scored one by one; the
    group of a case is its candidate list.  :func:`evaluate` ranks while it scores.
    """
    false = F.col("is_true") == 0
    listed = scored.groupBy("user_idx", "true_item").agg(
        F.max(F.when(~false, F.col("score"))).alias("_true"),
        F.collect_list(F.when(false, F.struct("score", "item_idx"))).alias("_others"),
    )

    def before(other: Column) -> Column:
        tie = (other["score"] == F.col("_true")) & (other["item_idx"] < F.col("true_item"))
        return (other["score"] > F.col("_true")) | tie

    return listed.where(F.col("_true").isNotNull()).select(
        "user_idx",
        F.col("true_item").alias("item_idx"),
        (F.size(F.filter("_others", before)) + 1).cast("bigint").alias("rank"),
        F.size("_others").cast("bigint").alias("n_candidates"),
    )


def rank_gains(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Ranked true rows with ``hit`` and ``ndcg`` at ``k``."""
    inside = F.col("rank") <= k
    gain = F.log(F.lit(2.0)) / F.log(F.col("rank") + F.lit(1.0))
    return ranks.select(
        "*",
        F.when(inside, 1.0).otherwise(0.0).alias("hit"),
        F.when(inside, gain).otherwise(0.0).alias("ndcg"),
    )


def ranking_metrics(test: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """One row ``(n_test, n_covered, min_candidates, mean_candidates, hit_ratio, ndcg)``.

    Counts are of test rows, so a case counts as often as ``test`` repeats it.  Candidates are
    those that were scored against a covered row.  Means are null without coverage.
    """
    rows = test.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).alias("_rows"))
    gains = rows.join(rank_gains(ranks, k), ["user_idx", "item_idx"], "left")
    found = F.when(F.col("rank").isNotNull(), F.col("_rows"))

    def mean(col: str) -> Column:
        return F.try_divide(F.sum(F.col(col) * found), F.sum(found))

    return gains.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_test"),
        F.coalesce(F.sum(found), F.lit(0)).alias("n_covered"),
        F.min("n_candidates").alias("min_candidates"),
        mean("n_candidates").alias("mean_candidates"),
        mean("hit").alias("hit_ratio"),
        mean("ndcg").alias("ndcg"),
    )


def prediction_error(test: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """One row ``(n_test, n_covered, coverage, rmse)``; rmse is null without coverage.

    Without a ``rating`` column the target is one.
    """
    n_test = test.agg(F.count(F.lit(1))).scalar()
    rating = F.col("rating").cast("double") if "rating" in test.columns else F.lit(1.0)
    miss = F.col("rating") - F.col("score")
    return (
        score_pairs(test.select("user_idx", "item_idx", rating.alias("rating")), users, items)
        .agg(F.count(F.lit(1)).alias("n_covered"), F.sum(miss * miss).alias("_sse"))
        .select(
            n_test.alias("n_test"),
            "n_covered",
            F.try_divide(F.col("n_covered").cast("double"), n_test).alias("coverage"),
            F.sqrt(F.try_divide(F.col("_sse"), F.col("n_covered"))).alias("rmse"),
        )
    )


def evaluate(
    test: DataFrame,
    users: DataFrame,
    items: DataFrame,
    n: int = 99,
    k: int = 10,
    seed: int = 42,
    mode: str = "uniform",
    seen: DataFrame | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Sampled ranking evaluation of a factor model; see :func:`ranking_metrics`.

    ``candidates`` may hold what :func:`negative_lists` gave before, for models over the same
    items; without it, negatives are drawn from the items that have a vector.
    """
    if candidates is None:
        ranks = rank_drawn(test, users, items, n, seed, mode, seen)
    else:
        ranks = rank_lists(_cases(test), candidates, users, items)
    return ranking_metrics(test, ranks, k)
