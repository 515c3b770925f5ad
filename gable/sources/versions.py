"""Tables in versions: each write makes new files and a manifest that names all files of its version; a manifest appears as a whole or not at all.

A writer that is killed leaves files that no manifest names, and the version before stays the newest. Of two writers that begin from one version, one
gets the next number and the other an error, so no write is lost. An append names the files of the version before and its own, so nothing is written again.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import maintenance


class WriteConflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class VersionedTable:
    """folder: in a store that driver and executors share. Manifests are small, however large the data: a line for each write that is still read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._context = self._fs.FileContext.getFileContext(self._fs.Path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """All versions, from 1."""
        if not self._context.util().exists(self._path("versions")):
            return []
        names = [f.getPath().getName() for f in self._context.util().listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/versions/{version:09d}.json", wholetext=True).collect()))

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest if none is named."""
        known = self.versions()
        if version is None and known:
            version = known[-1]
        if version not in known:
            raise FileNotFoundError(f"{self.folder} has no version {version}")
        found = self._manifest(version)
        return self.spark.read.schema(found["schema"]).parquet(*(f"{self.folder}/data/{d}" for d in found["data"]))

    def commit(self, rows: DataFrame, append: bool = False) -> int:
        """Write rows as the next version, or as what the next version has more than the newest; its number."""
        known = self.versions()
        before = self._manifest(known[-1]) if append and known else {"data": []}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        if before.get("schema", schema) != schema:
            raise ValueError(f"appended rows must have the columns {before['schema']}")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return self._publish({"schema": schema, "data": [*before["data"], name]}, (known[-1] if known else 0) + 1)

    def _publish(self, manifest: dict, version: int) -> int:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        hidden = self._path(f"versions/.{uuid.uuid4().hex}")
        flags = jvm.java.util.EnumSet.of(self._fs.CreateFlag.CREATE)
        options = gateway.new_array(getattr(self._fs, "Options$CreateOpts"), 1)
        options[0] = getattr(self._fs, "Options$CreateOpts").createParent()
        out = self._context.create(hidden, flags, options)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._context.rename(hidden, self._path(f"versions/{version:09d}.json"), gateway.new_array(getattr(self._fs, "Options$Rename"), 0))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self._context.delete(hidden, False)
            raise WriteConflict(f"version {version} of {self.folder} is there") from error
        return version

    def append(self, rows: DataFrame) -> int:
        return self.commit(rows, append=True)

    def upsert(self, rows: DataFrame, keys: list[str], keep: list[str] | None = None) -> int:
        """The next version with rows in the place of those of equal keys; columns in `keep` stay as they were."""
        held = self.read()
        return self.commit(maintenance.upsert(held, rows, keys, keep).select(*held.columns))

    def seed(self, rows: DataFrame, keys: list[str]) -> int:
        """The next version with the rows whose keys aren't there yet; only they are written."""
        held = self.read()
        return self.append(rows.join(held, keys, "left_anti").select(*held.columns))

    def purge(self, column: str, as_of: dt.datetime, days: int) -> int:
        """The next version without rows over `days` old."""
        return self.commit(maintenance.retained(self.read(), column, as_of, days))
