"""Keyed store of a job: one batch of files and a result for each of them, as Parquet in a folder.

Writes are appended with a version, so a reader never sees half of one; a key's last write counts, and a deletion is a
write of its own.  `compact` rewrites what counts."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.operators.jobs import MAX_BYTES, MAX_ITEMS, RESERVE
from markfield.streaming.queue import latest


def limit_reason(count: int, size: int) -> str:
    """Why a batch of so many files and bytes cannot be taken; too many files is said first."""
    if count > MAX_ITEMS:
        return f"超过 {MAX_ITEMS} 张"
    return f"原图超过 {MAX_BYTES // 1048576}MB" if size > MAX_BYTES else ""


def new_ids(rows: DataFrame) -> DataFrame:
    """Rows without an id get one of their own."""
    return rows.withColumn("id", F.coalesce("id", F.expr("uuid()")) if "id" in rows.columns else F.expr("uuid()"))


@dataclass
class JobStore:
    spark: SparkSession
    path: str
    quota: int | None = None

    def _folder(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read(self, name: str) -> DataFrame | None:
        files, at = self._folder(name)
        return self.spark.read.option("mergeSchema", "true").parquet(str(at)) if files.exists(at) else None

    def summary(self) -> dict:
        """Bytes used, quota and what is free; the last two are None without a quota."""
        files, at = self._folder("")
        used = files.getContentSummary(at).getLength() if files.exists(at) else 0
        return {"used": used, "quota": self.quota, "free": None if self.quota is None else max(0, self.quota - used)}

    def ensure(self, extra: int) -> None:
        """An error where a tenth of the quota and RESERVE would not stay free."""
        told = self.summary()
        if self.quota and max(0, self.quota * 0.9 - told["used"]) < extra + RESERVE:
            raise OSError(f"{max(0, self.quota * 0.9 - told['used']) / 1048576:.0f} MB are free")

    def save_batch(self, files: DataFrame) -> dict:
        """files: id, at, name, type, content.  Taken whole, in place of the batch before, or not at all."""
        told = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("size")).first()
        if why := limit_reason(told.n, told.size):
            return {"saved": False, "reason": why}
        self.ensure(told.size)
        files.write.mode("overwrite").parquet(f"{self.path}/batch")
        return {"saved": True, "bytes": told.size}

    def load_batch(self) -> DataFrame | None:
        found = self._read("batch")
        return None if found is None else found.orderBy("at")

    def save_results(self, results: DataFrame) -> None:
        """results: id, status, content and any other columns."""
        self.ensure(results.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0])
        self._append(results.withColumn("gone", F.lit(False)))

    def delete_results(self, ids: DataFrame) -> None:
        self._append(ids.select("id").withColumn("gone", F.lit(True)))

    def _append(self, rows: DataFrame) -> None:
        rows.withColumn("saved_at", F.lit(time.time_ns())).write.mode("append").parquet(f"{self.path}/results")

    def results(self) -> DataFrame | None:
        """The stored result of every key that has one."""
        found = self._read("results")
        return None if found is None else latest(found, "id", "saved_at").where("not gone").drop("gone")

    def load_result(self, key) -> dict | None:
        found = self.results()
        row = None if found is None else found.where(F.col("id") == key).first()
        return None if row is None else row.asDict()

    def restore(self) -> DataFrame | None:
        """The batch's files with their results: status pending where there is none."""
        batch, found = self.load_batch(), self.results()
        if batch is None:
            return None
        if found is None:
            return batch.select("id", "at", "name", F.lit("pending").alias("status"))
        kept = found.select("id", F.col("status").alias("kept"))
        return batch.join(kept, "id", "left").select("id", "at", "name", F.coalesce("kept", F.lit("pending")).alias("status")).orderBy("at")

    def compact(self) -> None:
        found = self.results()
        if found is not None:
            found.withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/compacted")
            files, at = self._folder("results")
            files.delete(at, True)
            files.rename(self._folder("compacted")[1], at)

    def clear(self) -> None:
        for name in ("batch", "results"):
            files, at = self._folder(name)
            files.delete(at, True)
