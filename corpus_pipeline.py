"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markfield.llm import stages
from markfield.llm.shared import cut, table

STAGES = [
    ("quality_rules", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.simhash_dedup),
    ("suffix_array_dedup", stages.suffix_dedup),
    ("best_fit_packing", stages.packing),
]

#: No SQL: the near-duplicate components and the packing are not expressible; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
