"""Activity filters on an interaction table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tacit.operators.selection import first_rows
from tacit.scratch import Stored, scratch_path, store

# Ranking cuts up to this many ids are marked for broadcast; above it Catalyst decides by size.
BROADCAST_IDS = 100_000
# Passes of a k-core that scan all pairs, before these are written in folders by id.
SCANS = 3
# Pairs of a folder in the mean, the most folders, and files of one.
BUCKET_PAIRS, MOST_BUCKETS, BUCKET_FILES = 1 << 20, 2048, 8


def count_by(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value of ``col``, nulls left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def threshold_filter(df: DataFrame, user_col: str, item_col: str, k: int) -> DataFrame:
    """Rows whose user and item both have at least ``k`` rows, counted before any filtering."""
    users = count_by(df, user_col).where(F.col("n") >= k).select(user_col)
    items = count_by(df, item_col).where(F.col("n") >= k).select(item_col)
    kept = df.join(users, user_col, "left_semi").join(items, item_col, "left_semi")
    return kept.select(*df.columns)


def top_ids(df: DataFrame, col: str, n: int | None) -> DataFrame:
    """The ``n`` most frequent values of ``col`` (ties: smaller value first); None keeps all."""
    counts = count_by(df, col)
    if n is None:
        return counts.select(col)
    top = first_rows(counts, -F.col("n"), [col], n).select(col)
    return F.broadcast(top) if n <= BROADCAST_IDS else top


def top_n_filter(
    df: DataFrame, user_col: str, item_col: str, n_users: int | None, n_items: int | None
) -> DataFrame:
    """Rows between the most active users and the most popular items, each counted on ``df``."""
    users = top_ids(df, user_col, n_users)
    items = top_ids(df, item_col, n_items)
    kept = df.join(users, user_col, "left_semi").join(items, item_col, "left_semi")
    return kept.select(*df.columns)


@dataclass(frozen=True)
class Peeling:
    """Ids that a k-core drops, and the number of passes (the last one only confirms)."""

    users: DataFrame
    items: DataFrame
    passes: int


class Adjacency:
    """Distinct pairs with their multiplicity, found by user or by item.

    The first passes drop many ids and read all pairs.  Once the loop has proven long, pairs are
    written once more per side, in folders by a hash of that side's id; from then on a half-pass
    reads the folders of the ids just dropped.
    """

    def __init__(self, pairs: Stored, sides: tuple[str, str]):
        self.pairs, self.sides = pairs, sides
        self.folders: dict[str, Stored] = {}
        self.buckets = int(min(MOST_BUCKETS, max(2, pairs.rows // BUCKET_PAIRS)))
        self.read: list[int] = []  # pairs read by each half-pass that uses folders

    def _bucket(self, col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.buckets)).cast("int")

    def place(self) -> None:
        """Write the pairs by either side."""
        spark = self.pairs.frame.sparkSession
        for col in self.sides:
            path = scratch_path(spark, f"core-by-{col}")
            frame = self.pairs.frame.withColumn("_bucket", self._bucket(col))
            # A pair's other id salts the buckets, so a very active id is not one task.
            other = self.sides[1 - self.sides.index(col)]
            salt = F.pmod(F.xxhash64(other), F.lit(BUCKET_FILES))
            frame.repartition("_bucket", salt).write.partitionBy("_bucket").parquet(path)
            table = spark.read.parquet(path).withColumn("_bucket", F.col("_bucket").cast("int"))
            self.folders[col] = Stored(table, path, self.pairs.rows)

    def of(self, col: str, ids: Stored) -> DataFrame:
        """The pairs of ``ids``."""
        if col not in self.folders:
            return self.pairs.frame.join(_marked(ids), col, "left_semi")
        # At most one row a bucket.
        wanted = [row[0] for row in ids.frame.select(self._bucket(col)).distinct().collect()]
        part = self.folders[col].frame.where(F.col("_bucket").isin(wanted))
        self.read.append(part.count())
        return part.drop("_bucket").join(_marked(ids), col, "left_semi")

    def drop(self) -> None:
        for table in (self.pairs, *self.folders.values()):
            table.drop()


def peel(df: DataFrame, user_col: str, item_col: str, k: int, scans: int = SCANS) -> Peeling:
    """Find the users and items outside the k-core.

    The loop runs on distinct pairs with their multiplicity, so copies of a pair cost one row.
    Degrees of users and items are counted once.  From then on a half-pass fetches the pairs of
    the ids just dropped and subtracts them from the degrees of the other side.  The first
    ``scans`` passes scan all pairs for them, later ones read by bucket (:class:`Adjacency`).  A
    pass drops light users, then light items.
    """
    return _peel(df, user_col, item_col, k, scans)[0]


def _peel(df: DataFrame, user_col: str, item_col: str, k: int, scans: int) -> tuple[Peeling, list[int]]:
    """:func:`peel`, and how many pairs the half-passes read that went by bucket."""
    sides = (user_col, item_col)
    pairs = store(
        df.where(F.col(user_col).isNotNull() & F.col(item_col).isNotNull())
        .groupBy(user_col, item_col)
        .agg(F.count(F.lit(1)).alias("n")),
        "core-pairs",
    )
    adjacency = Adjacency(pairs, sides)
    # A dropped id leaves its table, so pairs with it count no second time.
    degrees = {
        col: store(pairs.frame.groupBy(col).agg(F.sum("n").alias("n")), "core-degrees")
        for col in sides
    }
    dropped: dict[str, list[Stored]] = {col: [] for col in sides}
    passes = 0
    while True:
        passes += 1
        removed = 0
        if passes == scans + 1:
            adjacency.place()
        for col, other in (sides, sides[::-1]):
            light = store(degrees[col].frame.where(F.col("n") < k).select(col), "core-dropped")
            if not light.rows:
                light.drop()
                continue
            removed += light.rows
            dropped[col].append(light)
            loss = adjacency.of(col, light).groupBy(other).agg(F.sum("n").alias("_loss"))
            lower = degrees[other].frame.join(loss, other, "left").select(
                other, (F.col("n") - F.coalesce("_loss", F.lit(0))).alias("n")
            )
            degrees[other] = _replaced(degrees[other], lower, "core-degrees")
            degrees[col] = _replaced(
                degrees[col], degrees[col].frame.where(F.col("n") >= k), "core-degrees"
            )
        if not removed:
            break
    empty = {col: pairs.frame.select(col).limit(0) for col in sides}
    lists = {col: [s.frame for s in dropped[col]] or [empty[col]] for col in sides}
    whole = {
        col: store(reduce(DataFrame.unionByName, lists[col]), "core-ids").frame for col in sides
    }
    adjacency.drop()
    for spent in (*degrees.values(), *(s for col in sides for s in dropped[col])):
        spent.drop()
    return Peeling(whole[user_col], whole[item_col], passes), adjacency.read


def _replaced(old: Stored, frame: DataFrame, name: str) -> Stored:
    fresh = store(frame, name)
    old.drop()
    return fresh


def _marked(table: Stored) -> DataFrame:
    """For broadcast if short; above, Catalyst decides by size."""
    return F.broadcast(table.frame) if table.rows <= BROADCAST_IDS else table.frame


def kcore(df: DataFrame, user_col: str, item_col: str, k: int = 10) -> DataFrame:
    """Rows of the k-core: every remaining user and item has at least ``k`` remaining rows.

    Rows count, not distinct partners.  Rows with a null id are dropped, all columns stay.
    """
    core = peel(df, user_col, item_col, k)
    return (
        df.where(F.col(user_col).isNotNull() & F.col(item_col).isNotNull())
        .join(core.users, user_col, "left_anti")
        .join(core.items, item_col, "left_anti")
        .select(*df.columns)
    )
