"""A keyed table of Parquet folders that streams update: a version becomes visible at once, by the name of its manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewell.operators import telemetry as T


class Conflict(RuntimeError):
    """Another writer has committed a version meanwhile."""


class UpsertTable:
    """The latest row of each key, by `order`. Rows are dealt to `parts` parts by a hash of the key; an update writes new
    folders for the parts it touches and then a manifest that names the folders of all parts. What a lost writer has
    left is named by none, and no reader sees it. One row of the manifest is a part: `parts` is chosen once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], parts: int = 16) -> None:
        self.spark, self.path, self.keys, self.order, self.parts = spark, path.rstrip("/"), list(keys), list(order), parts
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """The newest: version, schema and the folder of each part."""
        named = [n for n in self._names("manifests") if n.endswith(".json")]
        if not named:
            return {"version": 0, "parts": self.parts, "schema": None, "folders": {}}
        stream = self._fs.open(self._at(f"manifests/{named[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, before: dict, schema: str, folders: dict[str, str]) -> dict:
        """The version after `before`, if no other writer has made it: the manifest's name is taken by a rename that doesn't replace."""
        new = {"version": before["version"] + 1, "parts": before["parts"], "schema": schema, "folders": before["folders"] | folders}
        staged, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{new['version']:012d}.json")
        out = self._fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise Conflict(f"version {new['version']} is there")
        return new

    def read(self, version: dict | None = None, parts: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of the newest version, or of some of its parts; None before the first."""
        now = self.manifest() if version is None else version
        folders = [f for p, f in now["folders"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else None

    def upsert(self, batch: DataFrame, tries: int = 3) -> dict:
        """The version after the batch. A batch that comes again changes no row; a conflict is tried again on the newer version."""
        for left in reversed(range(tries)):
            before = self.manifest()
            try:
                return self._upsert(batch, before)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _upsert(self, batch: DataFrame, before: dict) -> dict:
        part = F.pmod(F.xxhash64(*self.keys), F.lit(before["parts"])).cast("int")
        rows = batch.withColumn("_part", part)
        touched = sorted(r._part for r in rows.select("_part").distinct().collect())  # at most `parts`
        if not touched:
            return before
        if (old := self.read(before, touched)) is not None:
            rows = rows.unionByName(old.withColumn("_part", part), allowMissingColumns=True)
        new = T.latest(rows, self.keys, self.order)
        run = uuid.uuid4().hex
        new.repartition(len(touched), "_part").write.partitionBy("_part").parquet(f"{self.path}/data/{run}")
        schema = new.drop("_part").schema
        if before["schema"]:  # columns that only parts which stay as they are have
            known = StructType.fromJson(json.loads(before["schema"]))
            schema = StructType([*schema, *(f for f in known if f.name not in schema.names)])
        return self.commit(before, schema.json(), {str(p): f"{run}/_part={p}" for p in touched})

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def write(batch: DataFrame, epoch: int) -> None:
            self.upsert(batch)

        return write

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the newest `keep`, and the folders that none of those names. No writer may be at work: its folders are named by none yet."""
        named = [n for n in self._names("manifests") if n.endswith(".json")]
        used = set()
        for n in named[-keep:]:
            stream = self._fs.open(self._at(f"manifests/{n}"))
            used |= {f.split("/")[0] for f in json.loads(bytes(stream.readAllBytes()).decode())["folders"].values()}
            stream.close()
        for n in named[:-keep]:
            self._fs.delete(self._at(f"manifests/{n}"), False)
        for run in self._names("data"):
            if run not in used:
                self._fs.delete(self._at(f"data/{run}"), True)
