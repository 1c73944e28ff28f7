"""All queries of the image-mark operators and their SQL."""

from __future__ import annotations

from functools import partial
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from markfield.functions.dialect import Duck, Spark, render

#: Modules with QUERIES (name to operator declared as SQL, but for the names in NO_SQL with SQL that DuckDB runs too) or
#: PROGRAMS (name to function of (spark, sf_dir); what SQL cannot express).
MODULES = [import_module(f"markfield.operators.{m}") for m in ("pixels", "rules", "text", "jobs", "detectors")]
OPERATORS = {k: v for m in MODULES for k, v in getattr(m, "QUERIES", {}).items()}
PROGRAMS = {k: v for m in MODULES for k, v in getattr(m, "PROGRAMS", {}).items()}
NO_SQL = {k for m in MODULES for k in getattr(m, "NO_SQL", ())}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(render(OPERATORS[name], Spark(sf_dir)))


QUERIES = {name: partial(run, name) for name in OPERATORS} | PROGRAMS
SQL = {name: render(f, Duck()) for name, f in OPERATORS.items() if name not in NO_SQL}
