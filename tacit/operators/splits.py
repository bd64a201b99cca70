"""Train/test splits that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tacit.functions import draw, uniform
from tacit.functions.draws import DRAW_RANGE
from tacit.operators.selection import first_rows
from tacit.scratch import materialize


def random_split(
    df: DataFrame, keys: list[str], fraction: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split rows by a draw on ``keys``; rows that agree in all keys stay together."""
    chosen = uniform(*[F.col(k) for k in keys], seed=seed) < F.lit(float(fraction))
    return df.where(chosen), df.where(~chosen)


def sample_users(interactions: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """``n`` distinct users by ascending draw; None keeps every user."""
    users = interactions.select("user_idx").distinct()
    if n is None:
        return users
    return first_rows(users, draw(F.col("user_idx"), "sample", seed=seed), ["user_idx"], n)


def leave_one_out(
    interactions: DataFrame, n_users: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Hide one random row of each user, or of ``n_users`` sampled ones: ``(train, test)``.

    Every row of a user is equally likely, so a pair with n copies is n times as likely as one
    with a single copy: the smallest of n exponential draws is one draw divided by n.  Copies are
    counted on the map side and the hidden row is a plain minimum, so a user with a huge history
    is never sorted in one task.  All copies of a hidden pair leave train.  The hidden rows are
    stored, since both parts read them.
    """
    rest = [c for c in interactions.columns if c not in ("user_idx", "item_idx")]
    candidates = interactions
    if n_users is not None:
        candidates = interactions.join(
            sample_users(interactions, n_users, seed), "user_idx", "left_semi"
        )
    pairs = candidates.groupBy("user_idx", "item_idx").agg(
        F.count(F.lit(1)).alias("_n"), *([F.min(F.struct(*rest)).alias("_rest")] if rest else [])
    )
    drawn = draw(F.col("user_idx"), F.col("item_idx"), seed=seed).cast("double")
    order = -F.log((drawn + F.lit(1.0)) / F.lit(DRAW_RANGE)) / F.col("_n")
    hidden = pairs.groupBy("user_idx").agg(
        F.min(F.struct(order.alias("draw"), "item_idx", *(["_rest"] if rest else []))).alias("row")
    )
    test = hidden.select("user_idx", "row.item_idx", *[f"row._rest.{c}" for c in rest])
    # Both parts read the hidden rows, so they are found once.
    test = materialize(test.select(*interactions.columns), "hidden")
    train = interactions.join(
        test.select("user_idx", "item_idx"), ["user_idx", "item_idx"], "left_anti"
    )
    return train.select(*interactions.columns), test
