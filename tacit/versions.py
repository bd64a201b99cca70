"""Folders whose contents are replaced as a whole: sub-folders, and manifests that name them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

# Manifests that stay besides the newest, for readers of what they name.
KEPT = 1


class Versions:
    """Numbered manifests of a folder.  The newest counts, and only once it is there whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.jvm = spark._jvm
        self.files = self.place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        place = self.place("manifests")
        if not self.files.exists(place):
            return []
        found = (entry.getPath().getName() for entry in self.files.listStatus(place))
        return sorted(name for name in found if name.endswith(".json"))

    def read(self, name: str) -> dict:
        stream = self.files.open(self.place(f"manifests/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> dict | None:
        known = self.names()
        return self.read(known[-1]) if known else None

    def commit(self, manifest: dict) -> None:
        """Make ``manifest`` the newest.  Its ``parts`` list the sub-folders that it needs."""
        known = self.names()
        name = f"{int(known[-1].removesuffix('.json')) + 1 if known else 1:012}.json"
        draft = self.place(f"manifests/.{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        final = self.place(f"manifests/{name}")
        if self.files.exists(final) or not self.files.rename(draft, final):
            raise RuntimeError(f"another writer of {self.path} was faster")

    def tidy(self) -> None:
        """Drop all manifests but the newest ones, and the parts that only the dropped name."""
        known = self.names()
        needed = {part for name in known[-1 - KEPT :] for part in self.read(name)["parts"]}
        for name in known[: -1 - KEPT]:
            parts = set(self.read(name)["parts"])
            self.files.delete(self.place(f"manifests/{name}"), False)
            for part in parts - needed:
                self.files.delete(self.place(part), True)
