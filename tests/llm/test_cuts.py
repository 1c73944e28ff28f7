"""Tables of cuts: what a settled call has written on the way is deleted with its result's write, and nothing else."""

from pathlib import Path

import pytest
from fixtures import CLASHING

import corpus_pipeline
from markfield.llm import shared
from markfield.llm.shared import cut, settled

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folders(spark):
    return {p for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("markfield-*")}


def test_settled_keeps_its_result_alone(spark):
    before = folders(spark)
    given = cut(spark.range(100))
    own = folders(spark) - before

    @settled()
    def inner(df):
        return cut(df.where("id % 2 = 0")).where("id % 3 = 0")

    @settled(1)
    def outer(df):
        a, b = inner(df), cut(df.where("id > 50"))
        assert a.count() == 17 and len(folders(spark) - before) == 3
        return a.join(b, "id")

    out = outer(given)
    assert given.count() == 100 and sorted(r.id for r in out.collect()) == [*range(54, 100, 6)]
    assert len(folders(spark) - before) == 2 and own < folders(spark)


def test_settled_that_fails_leaves_its_tables_to_the_outer_one(spark):
    before = folders(spark)

    @settled()
    def inner():
        cut(spark.range(3))
        raise ValueError

    @settled()
    def outer():
        with pytest.raises(ValueError):
            inner()
        assert len(folders(spark) - before) == 1
        return spark.range(5)

    assert outer().count() == 5 and len(folders(spark) - before) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_no_texts_behind(spark, name):
    """Tables that a stage's result reads stay; they are small beside the texts, and those of stages add up."""
    text = lambda i: " ".join(f"w{i}x{k} is one of" for k in range(2000))
    docs = spark.createDataFrame([(i, text(i % 30), "en", "s", len(text(i % 30))) for i in range(60)], DOCS)
    before = folders(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    left = sum(f.stat().st_size for d in folders(spark) - before for f in d.rglob("*.parquet"))
    assert left < 150_000
    assert out.count() > 0 or name == "quality_rules"


def test_quality_tells_rows_apart(spark):
    """One doc_id, also null, with several texts, languages and sources; the columns are the rows' own."""
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, t, lang, source, k) for k, (i, t, lang, source) in enumerate((i, t, lang, source) for i in (1, None) for t in (good, bad, None, good) for lang in ("en", "", None) for source in ("s", None))]
    docs = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        docs = docs.withColumn(c, docs.n_chars)
    out = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(map(str, out.select(*DOCS.replace(",", "").split()[::2]).collect())) == sorted(str(r) for r in docs.select(*DOCS.replace(",", "").split()[::2]).collect() if r.text == good)
