"""Model manifests: parts of a file, what of them is there, and the check of the whole.

A manifest is JSON with totalSize, sha256 and chunks (file, size).  Parts lie in a folder under their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "totalSize long, sha256 string, chunks array<struct<file string, size long>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """model (the manifest's folder), total, sha256, idx, file, size, offset of every part; one that has no parts or no total
    is an error."""
    told = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).withColumn("model", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))
    wrong = F.raise_error(F.concat(F.lit("not a manifest: "), F.col("model")))
    told = told.withColumn("chunks", F.when(F.col("totalSize").isNull() | F.col("chunks").isNull(), wrong.cast("array<struct<file string, size long>>")).otherwise(F.col("chunks")))
    each = told.select("model", F.col("totalSize").alias("total"), "sha256", "chunks", F.posexplode("chunks").alias("idx", "c"))
    before = F.aggregate(F.slice("chunks", F.lit(1), F.col("idx")), F.lit(0).cast("long"), lambda n, c: n + c["size"])
    return each.select("model", "total", "sha256", "idx", "c.file", "c.size", before.alias("offset"))


def coverage(parts: DataFrame, files: DataFrame) -> DataFrame:
    """model, total, have: parts and those of them that are there with their size.  files: file, length."""
    there = files.select(F.col("file"), F.col("length").alias("size")).distinct().withColumn("there", F.lit(True))
    return parts.join(there, ["file", "size"], "left").groupBy("model").agg(F.count("*").alias("total"), F.count("there").alias("have"))


def verified(parts: DataFrame, contents: DataFrame) -> DataFrame:
    """model, size, sha256, ok: the digest of a model's parts one after another, read part by part.  contents: file, content."""
    told = parts.join(contents, "file", "left").repartition("model").sortWithinPartitions("model", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, digest, size, whole, want = None, hashlib.sha256(), 0, True, (None, None)

        def done() -> pa.RecordBatch:
            ok = whole and size == want[0] and (want[1] is None or digest.hexdigest() == want[1])
            return pa.record_batch([pa.array([model]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()]), pa.array([ok])], ["model", "size", "sha256", "ok"])

        for b in batches:
            for name, total, sha, part, content in zip(*(b[c].to_pylist() for c in ("model", "total", "sha256", "size", "content")), strict=True):
                if name != model:
                    if model is not None:
                        yield done()
                    model, digest, size, whole, want = name, hashlib.sha256(), 0, True, (total, sha)
                digest.update(content or b"")
                size += len(content or b"")
                whole = whole and content is not None and len(content) == part
        if model is not None:
            yield done()

    return told.select("model", "total", "sha256", "size", "content").mapInArrow(run, "model string, size long, sha256 string, ok boolean")
