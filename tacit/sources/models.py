"""Factor tables and id maps on disk."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tacit.versions import Versions


@dataclass(frozen=True)
class FactorModel:
    """``users``: user_idx, factors.  ``items``: item_idx, factors.

    ``user_ids`` and ``item_ids`` map raw ids to these indices, where the caller has added them.
    """

    users: DataFrame
    items: DataFrame
    user_ids: DataFrame | None = None
    item_ids: DataFrame | None = None


TABLES = ("users", "items", "user_ids", "item_ids")


def save_model(model: FactorModel, path: str) -> None:
    """Write the model's tables as a new version below ``path`` and make it the current one.

    A version is a folder of its own, and a manifest that lists its tables is written last: until
    then, and if the save breaks, readers get the model before, whole.  Tables that are None are
    not listed, so nothing of an older model shows through.  The model may come from ``path``.
    The version before stays for its readers; older ones are deleted.
    """
    spark = model.users.sparkSession
    folder = Versions(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    tables = [name for name in TABLES if getattr(model, name) is not None]
    for name in tables:
        getattr(model, name).write.parquet(f"{folder.path}/{version}/{name}")
    folder.commit({"parts": [version], "tables": tables})
    folder.tidy()


def load_model(spark: SparkSession, path: str) -> FactorModel:
    """The model saved last, with its id maps if it has them."""
    folder = Versions(spark, path)
    manifest = folder.newest()
    if manifest is None:
        raise FileNotFoundError(f"no saved model in {path}")
    (version,) = manifest["parts"]
    return FactorModel(
        **{name: spark.read.parquet(f"{folder.path}/{version}/{name}") for name in manifest["tables"]}
    )
