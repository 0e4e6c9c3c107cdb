"""A durable dictionary: versioned Parquet snapshots, log segments and a manifest that is written last.

A version is never changed: writes go to a new folder, and the manifest (a small JSON file) names the current one
with the log position and stream batch that it includes. Manifests are numbered, the one with the greatest number
holds, and the one before it goes only when the next is there. A writer that dies leaves a folder that no manifest
names; open_with_recovery() removes it and replays the log. Without any manifest nothing is removed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import oplog
from termloom.sources import shared


@dataclass
class Manifest:
    version: int = 0
    checkpoint_lsn: int = 0
    batch_id: int = -1
    overlay: bool = False
    retained: list[int] = field(default_factory=list)


@dataclass
class Store:
    spark: SparkSession
    path: str
    manifest: Manifest
    schema: str = "term string, value bigint"

    # --- create, open, repair (IO-19, L-06)

    @classmethod
    def create(cls, spark: SparkSession, path: str, overlay: bool = False, schema: str = "term string, value bigint") -> "Store":
        if cls._manifests(spark, path):
            raise FileExistsError(path)
        store = cls(spark, path, Manifest(overlay=overlay), schema)
        store._write_manifest()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str = "term string, value bigint") -> "Store":
        found = cls._manifests(spark, path)
        if not found:
            raise FileNotFoundError(path)
        return cls(spark, path, Manifest(**json.loads(shared.read_small(spark, f"{path}/{found[-1]}"))), schema)

    @classmethod
    def open_with_recovery(cls, spark: SparkSession, path: str, bad=None, overlay: bool = False, schema: str = "term string, value bigint") -> tuple["Store", dict]:
        """(store, report). mode: created, normal, repaired (a stray version went) or rebuilt (from the log alone).

        A folder with versions but no manifest is not touched: FileNotFoundError. overlay is that of a new store.

        bad: a condition on log records that marks a corrupt one; the log is trusted before the first.
        """
        versions = [n for n in shared.names(spark, path) if n.startswith("v=")]
        if not cls._manifests(spark, path):
            if versions:
                raise FileNotFoundError(f"{path} has versions but no manifest")
            store = cls.create(spark, path, overlay, schema)
            mode = "rebuilt" if store.log() is not None else "created"
            stray = []
        else:
            store = cls.open(spark, path, schema)
            stray = [v for v in versions if int(v[2:]) not in {store.manifest.version, *store.manifest.retained}]
            mode = "repaired" if stray else "normal"
        for name in stray:
            shared.delete(spark, f"{path}/{name}")
        before = store.manifest.checkpoint_lsn
        store.checkpoint(bad)
        return store, {"mode": mode, "stray_versions": len(stray), "from_lsn": before, "to_lsn": store.manifest.checkpoint_lsn}

    @staticmethod
    def _manifests(spark: SparkSession, path: str) -> list[str]:
        return [n for n in shared.names(spark, path) if n.startswith("manifest-") and n.endswith(".json")]

    def _write_manifest(self) -> None:
        old = self._manifests(self.spark, self.path)
        number = int(old[-1][9:-5]) + 1 if old else 1
        shared.write_small(self.spark, f"{self.path}/manifest-{number:012d}.json", json.dumps(asdict(self.manifest)))
        for name in old:
            shared.delete(self.spark, f"{self.path}/{name}")

    # --- reading

    def read(self, version: int | None = None) -> DataFrame:
        version = self.manifest.version if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def log(self) -> DataFrame | None:
        """All log records with their segment, or None without a log."""
        return self.spark.read.schema(f"{oplog.SCHEMA}, segment bigint").parquet(f"{self.path}/log") if shared.names(self.spark, f"{self.path}/log") else None

    # --- writing (L-08, L-10, L-11, M-15)

    def append(self, records: DataFrame) -> None:
        """Records become the next log segment."""
        found = [int(n[8:]) for n in shared.names(self.spark, f"{self.path}/log") if n.startswith("segment=")]
        records.write.parquet(f"{self.path}/log/segment={max(found, default=0) + 1}")

    def publish(self, df: DataFrame, lsn: int | None = None, batch_id: int | None = None, retain: int = 3) -> int:
        """df becomes the next version; versions beyond the last retain go."""
        m = self.manifest
        target = m.version + 1
        ordered = df.repartitionByRange("term").sortWithinPartitions("term")
        ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v={target}")
        kept = [v for v in [*m.retained, m.version] if v > 0][-(retain - 1) :] if retain > 1 else []
        gone = [v for v in [*m.retained, m.version] if v > 0 and v not in kept]
        self.manifest = Manifest(target, m.checkpoint_lsn if lsn is None else lsn, m.batch_id if batch_id is None else batch_id, m.overlay, kept)
        self._write_manifest()
        for v in gone:
            shared.delete(self.spark, f"{self.path}/v={v}")
        return target

    def checkpoint(self, bad=None) -> int:
        """Replays the log behind the checkpoint on the current version; does nothing without such records."""
        log = self.log()
        if log is None:
            return self.manifest.version
        log = log if bad is None else oplog.durable_prefix(log, bad)
        last = log.agg(F.max("lsn")).first()[0]
        if last is None or last <= self.manifest.checkpoint_lsn:
            return self.manifest.version
        ops = oplog.ranked(log, oplog.operations(log), self.manifest.overlay, self.manifest.checkpoint_lsn)
        return self.publish(oplog.reconcile(ops, self.read()), last)

    def compact(self) -> dict:
        """Rewrites the current version, checks that it says the same, and drops the others."""
        before = self.read()
        files = len(before.inputFiles())
        old = self.manifest.version
        self.publish(before, retain=2)
        after = self.read()
        if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
            raise ValueError(f"compaction of version {old} changed its content")
        return {"version": self.manifest.version, "files_before": files, "files_after": len(after.inputFiles())}

    def prune_log(self) -> int:
        """Deletes the segments that the checkpoint includes whole; returns how many."""
        log = self.log()
        if log is None:
            return 0
        done = log.groupBy("segment").agg(F.max("lsn").alias("last")).where(F.col("last") <= self.manifest.checkpoint_lsn).select("segment").collect()
        for row in done:
            shared.delete(self.spark, f"{self.path}/log/segment={row[0]}")
        return len(done)

    def stats(self) -> dict:
        log = self.log()
        last = 0 if log is None else log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
        m = self.manifest
        return {"version": m.version, "checkpoint_lsn": m.checkpoint_lsn, "current_lsn": max(last, m.checkpoint_lsn), "is_dirty": last > m.checkpoint_lsn, "terms": self.read().count()}
