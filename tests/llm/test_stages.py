"""Every pipeline stage on rows with repeated and null doc_ids, nulls, clashing columns, and on an empty table."""

from collections import Counter

import pytest
from fixtures import CLASHING

import corpus_pipeline
from markfield.llm import stages

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for c in CLASHING:
        df = df.withColumn(c, df.doc_id)
    return df


PASSAGE = "a passage of well over fifty bytes that several of these documents have in common; "


def repeated():
    return [(2, "first " + PASSAGE), (2, "second " + PASSAGE), (2, "second " + PASSAGE), (None, "third " + PASSAGE), (None, PASSAGE + "fourth"), (1, "own text"), (5, None), (6, "")]


def test_suffix_stage_keeps_every_row(spark):
    docs = docs_of(spark, [(0, "zero " + PASSAGE), *repeated()])
    out = stages.suffix_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    want = [(0, "zero " + PASSAGE), (2, "first"), (2, "second"), (2, "second"), (None, "thir"), (None, "fourth"), (1, "own text"), (5, ""), (6, "")]
    assert got == Counter((i, t, len(t)) for i, t in want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_rows_and_columns(spark, name):
    docs = docs_of(spark, repeated() + [(9, " ".join(f"w{i}" for i in range(60)))] * 2)
    out = STAGES[name](spark, docs, "")
    rows = out.collect()
    if name == "best_fit_packing":
        assert sorted((r.doc_id is None, r.doc_id, r.start) for r in rows) == sorted((i is None, i, 0) for i in [*[i for i, _ in repeated()], 9, 9])
    else:
        assert out.columns == docs.columns
        assert all(r.m == r.doc_id for r in rows)  # a row keeps its own columns
    if name == "line_dedup":
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    if name == "quality_rules":
        assert [r.doc_id for r in rows] == [9, 9]
    if name == "simhash_near_dedup":
        assert Counter(r.doc_id for r in rows) == Counter([2, 1, 5, 9])  # the passages are alike, and so are texts without words


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty(spark, name):
    docs = docs_of(spark, [(1, "x")]).limit(0)
    out = STAGES[name](spark, docs, "")
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
