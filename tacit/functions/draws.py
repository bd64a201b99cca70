"""Random draws that are functions of keys.

A draw hashes its keys and a seed, so it does not change with partitioning, retries or row
order.  Other engines with md5 get the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DRAW_RANGE = float(2**32)
# A digest has 32 hexadecimal digits, and a draw takes eight.
DRAWS_PER_DIGEST = 4


def digest(*keys: Column | str | int, seed: int) -> Column:
    """The md5 of keys and seed.  A ``str`` key is a constant; pass columns as ``F.col``."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def draw_from(made: Column, at: int = 0) -> Column:
    """Draw number ``at`` of a digest: a bigint in [0, 2**32)."""
    return F.conv(F.substring(made, 8 * at + 1, 8), 16, 10).cast("bigint")


def uniform_from(made: Column, at: int = 0) -> Column:
    """A double in [0, 1)."""
    return draw_from(made, at).cast("double") / F.lit(DRAW_RANGE)


def normal_from(made: Column, at: int = 0) -> Column:
    """A standard normal double, by the Box-Muller transform of draws 2*at and 2*at + 1."""
    radius = (draw_from(made, 2 * at).cast("double") + F.lit(1.0)) / F.lit(DRAW_RANGE)
    angle = uniform_from(made, 2 * at + 1)
    return F.sqrt(F.lit(-2.0) * F.log(radius)) * F.cos(F.lit(2.0 * math.pi) * angle)


def draw(*keys: Column | str | int, seed: int) -> Column:
    """A bigint in [0, 2**32)."""
    return draw_from(digest(*keys, seed=seed))


def uniform(*keys: Column | str | int, seed: int) -> Column:
    """A double in [0, 1)."""
    return uniform_from(digest(*keys, seed=seed))


def draw_below(bound: Column, *keys: Column | str | int, seed: int) -> Column:
    """A bigint in [0, bound)."""
    return F.pmod(draw(*keys, seed=seed), bound.cast("bigint"))


def normal(*keys: Column | str | int, seed: int) -> Column:
    """A standard normal double."""
    return normal_from(digest(*keys, seed=seed))
