"""Intermediate tables in the shared folder that the session names.

Iterative jobs cut their lineage by writing a parquet table and reading it back.  A written
table outlives any executor, carries true size statistics (so Catalyst chooses broadcast or
shuffle from real bytes) and lets later reads prune columns.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder of its own.  A cluster
    session without it is an error, because a machine-local folder is invisible to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    # Executors of a local-cluster session are processes of their own.
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tacit-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{scratch_root(spark)}/tacit/{name}-{uuid.uuid4().hex}"


class Stored:
    """A DataFrame written to the shared folder, with its row count and the path to drop it."""

    def __init__(self, frame: DataFrame, path: str, rows: int):
        self.frame = frame
        self.path = path
        self.rows = rows

    def drop(self) -> None:
        """Delete the files.  Only for tables that no live DataFrame reads any more."""
        spark = self.frame.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Tables of the open scopes, innermost last; every thread has scopes of its own.
_open: ContextVar[tuple[list[Stored], ...]] = ContextVar("tacit_scopes", default=())


@contextmanager
def scope():
    """Collect the tables stored inside, for :func:`release`; without it they stay.

    Where the block fails, its tables are dropped.
    """
    made: list[Stored] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    except BaseException:
        for table in made:
            table.drop()
        made.clear()
        raise
    finally:
        _open.reset(token)


def release(made: list[Stored], *kept: DataFrame) -> None:
    """Drop the tables of a scope that no frame of ``kept`` reads.

    The others pass to the enclosing scope, if there is one.
    """
    read = {file for frame in kept for file in frame.inputFiles()}
    folders = {re.sub(r"^file:/+", "/", file.rpartition("/")[0]) for file in read}
    for table in made:
        if re.sub(r"^file:/+", "/", table.path) not in folders:
            table.drop()
        elif _open.get():
            _open.get()[-1].append(table)
    made.clear()


def store(df: DataFrame, name: str) -> Stored:
    """Run ``df`` once into a parquet table of the shared folder, counting rows on the way."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    # A plan that proves empty while it runs may skip the count.
    made = Stored(spark.read.schema(df.schema).parquet(path), path, seen.get.get("rows", 0))
    if _open.get():
        _open.get()[-1].append(made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`store`, for tables that live as long as the session's folder."""
    return store(df, name).frame


def task_width(spark: SparkSession) -> int:
    """Partitions that keep every slot busy: the shuffle width, or the slots if there are more."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partition a narrow table by a hash before a step that multiplies its rows or work.

    Adaptive execution sizes partitions by their bytes and would leave such a step to few tasks;
    an explicit number is kept as it is.  Hashing the hash keeps the planner from dropping this
    shuffle in favour of an earlier, adaptively merged one on the same columns.
    """
    return df.repartition(task_width(df.sparkSession), F.xxhash64(*cols))
