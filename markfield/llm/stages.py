"""Pipeline stages: each takes documents and returns documents, with the decisions of one operator applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.line_dedup import dedup_lines
from markfield.llm.packing import pack, pieces
from markfield.llm.quality import keep_quality
from markfield.llm.shared import cut, importable, text_or_empty
from markfield.llm.shingles import representatives
from markfield.llm.suffix_dedup import dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  A null text has no words and goes; repeated rows and rows without a doc_id
    are judged each; an empty table stays empty; columns of any name pass by unchanged."""
    return keep_quality(spark, docs)


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates beyond the first document that has them.  A null text stays
    null; repeated rows are one document and both keep the same lines; a null doc_id counts as larger than all; an empty
    table stays empty; columns of any name pass by (n_chars follows the text)."""
    return _with_text(dedup_lines(docs), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more; found by SimHash, then by an
    exact join for what it misses), the one with the smallest doc_id.  (Documents that lost all their lines are alike, so one of them stays.)  Groups without a doc_id keep
    one row as well; of repeated rows one stays; of rows with one doc_id and different texts each text is a document; an
    empty table stays empty; columns of any name pass by unchanged."""
    importable(spark)
    return representatives(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that a document with a smaller doc_id has.  Every row stays a row: results are
    joined by doc_id (null with null) and the text's hash and length, one result each, so repeated rows and several texts
    of one doc_id keep their own.  A null text becomes empty; an empty table stays empty; columns of any name pass by
    (n_chars follows the text)."""
    found = dedup(docs.select("doc_id", "text"), text_too=True, once=True)
    found = found.select(F.col("doc_id").alias("doc__"), F.col("h").alias("hash__"), F.col("n_bytes").alias("bytes__"), F.col("kept").alias("text"))
    rows = docs.withColumns({"own_hash__": F.xxhash64(text_or_empty()), "own_bytes__": F.octet_length(text_or_empty())}).drop("text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("doc__")) & (F.col("own_hash__") == F.col("hash__")) & (F.col("own_bytes__") == F.col("bytes__"))
    return _with_text(rows.join(found, same), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences.  A null or empty text is one token; repeated rows are packed
    each; a null doc_id is kept; an empty table gives no piece; other columns are left."""
    import public_tokenizers

    importable(spark)
    return pack(cut(pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))
