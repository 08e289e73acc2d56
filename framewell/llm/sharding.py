"""Size-tiered compaction of immutable shards under a versioned manifest.

A table is a folder of runs and a folder of manifests. A run is a folder of Parquet shards that is
never changed; a manifest names the runs of one version. An append writes one small run; compaction
merges `fanout` runs of one size tier into a run of target-sized shards. Each commit writes the next
manifest under a free name and renames it into place: the rename fails where another writer was first,
and readers see the old version or the new one. A task or executor that is lost leaves nothing that a
manifest names.

Merges read and write shards without a shuffle; the driver holds names and sizes of runs only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm.common import new_folder, table

TARGET = 64 << 20
FANOUT = 4
#: Runs up to this size are the lowest tier.
SMALL = 1 << 20


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        folder = self._at("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "next": 0, "runs": []}
        stream = self._fs.open(self._at(f"manifests/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, based_on: dict, runs: list[dict], next_run: int) -> dict:
        new = {"version": based_on["version"] + 1, "next": next_run, "runs": runs}
        self._fs.mkdirs(self._at("manifests"))
        draft, final = self._at(f"manifests/.draft-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"), self._at(f"manifests/v{new['version']:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, no_overwrite)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new['version']} is there already") from e
            raise
        return new

    def _bytes(self, name: str) -> int:
        return int(self._fs.getContentSummary(self._at(name)).getLength())

    def append(self, df: DataFrame) -> dict:
        """df becomes a run of its own."""
        old = self.manifest()
        name = f"runs/r{old['next']:06d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
        df.write.parquet(f"{self.path}/{name}")
        return self.commit(old, [*old["runs"], {"run": old["next"], "level": 0, "path": name, "bytes": self._bytes(name)}], old["next"] + 1)

    def append_each(self, df: DataFrame, arrival: str) -> dict:
        """Each value of a column becomes a run, in order of the values; one pass writes them all. The column stays behind."""
        old = self.manifest()
        top = f"runs/a{old['next']:06d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
        df.write.partitionBy(arrival).parquet(f"{self.path}/{top}")
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(self._at(top)) if s.isDirectory()), key=lambda n: (len(n), n))
        new = old
        for name in names:
            run = {"run": new["next"], "level": 0, "path": f"{top}/{name}", "bytes": self._bytes(f"{top}/{name}")}
            new = self.commit(new, [*new["runs"], run], new["next"] + 1)
        return new

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / SMALL, self.fanout)))

    def compact(self) -> dict:
        """Merges while a tier has `fanout` runs."""
        while True:
            old = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in sorted(old["runs"], key=lambda r: r["run"]):
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
            full = [runs[: self.fanout] for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
            if not full:
                return old
            merged = full[0]
            name = f"runs/r{old['next']:06d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
            shards = max(1, round(sum(r["bytes"] for r in merged) / self.target))
            self._scan(merged).coalesce(shards).write.parquet(f"{self.path}/{name}")
            gone = {r["run"] for r in merged}
            new = {"run": old["next"], "level": 1 + max(r["level"] for r in merged), "path": name, "bytes": self._bytes(name)}
            while True:
                try:
                    self.commit(old, [*(r for r in old["runs"] if r["run"] not in gone), new], old["next"] + 1)
                    break
                except Conflict:  # the merge holds on as long as its runs do
                    old = self.manifest()
                    if not gone <= {r["run"] for r in old["runs"]}:
                        self._fs.delete(self._at(name), True)
                        break
                    new |= {"run": old["next"]}

    def vacuum(self, keep: int = 1, abandoned_hours: float = 24) -> None:
        """Deletes runs and manifests that none of the latest `keep` versions names, and run folders that no manifest ever named and that are older than abandoned_hours: those of writers that were lost or came second."""
        last = self.version()
        kept = {r["path"] for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v)["runs"]}
        for v in range(1, last - keep + 1):
            at = self._at(f"manifests/v{v:08d}.json")
            if self._fs.exists(at):
                for r in self.manifest(v)["runs"]:
                    if r["path"] not in kept:
                        self._fs.delete(self._at(r["path"]), True)
                self._fs.delete(at, False)
        before = self.spark._jvm.java.lang.System.currentTimeMillis() - int(abandoned_hours * 3_600_000)
        tops = {"/".join(r.split("/")[:2]) for r in kept}
        if self._fs.exists(self._at("runs")):
            for status in self._fs.listStatus(self._at("runs")):
                if f"runs/{status.getPath().getName()}" not in tops and status.getModificationTime() < before:
                    self._fs.delete(status.getPath(), True)

    def _scan(self, runs: list[dict]) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.path}/{r['path']}") for r in runs]
        if all(f.schema == frames[0].schema for f in frames):
            return self.spark.read.schema(frames[0].schema).parquet(*(f"{self.path}/{r['path']}" for r in runs))
        out = frames[0]
        for f in frames[1:]:  # runs may have gained columns
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None for a table without runs."""
        runs = self.manifest(version)["runs"]
        return self._scan(runs) if runs else None

    def shards(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version plus (run, level, shard); columns of the rows with these names, in any case, are left out here, read() has them."""
        out = None
        for r in self.manifest(version)["runs"]:
            shard = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
            rows = self.spark.read.parquet(f"{self.path}/{r['path']}")
            part = rows.select(*[F.col(c) for c in rows.columns if c.lower() not in ("run", "level", "shard")], F.lit(r["run"]).alias("run"), F.lit(r["level"]).alias("level"), shard.alias("shard"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


def compacted(docs: DataFrame, arrivals: int = 8, target: int = TARGET, fanout: int = FANOUT) -> ShardTable:
    """A table in the shared folder that got docs in arrivals (by hash of doc_id) and was compacted.

    All rows and columns are stored as they are: nulls, repeated rows, and any columns whose names are
    unlike in upper and lower case too. An empty table stays without runs.
    """
    store = ShardTable(docs.sparkSession, new_folder(docs.sparkSession, "shards"), target, fanout)
    name = "arrival"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    store.append_each(docs.withColumn(name, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), name)
    store.compact()
    store.vacuum()
    return store


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = compacted(docs)
    rows = store.shards()
    if rows is None:
        rows = docs.select("*", F.lit(0).alias("run"), F.lit(0).alias("level"), F.lit(0).alias("shard")).limit(0)
    return rows.select("doc_id", "run", "level", "shard", "n_chars", F.crc32("text").alias("text_crc32"))
