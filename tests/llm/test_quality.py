"""Quality rules: every group is judged, planted outliers go, odd rows as the SQL has them."""

import numpy as np
from conftest import SMALL

from markfield.llm import quality

STATS = "pool string, x1 long, x2 long, x3 long, x4 long, x5 long"


def test_some_documents_are_rejected_by_distance(spark):
    rows = quality.op4_quality_rules(spark, SMALL).collect()
    beyond = [r for r in rows if not r.base_failed and not r.kept]
    assert 0 < len(beyond) < 0.1 * len(rows)
    assert all(100 * r.n_symbols > r.word_chars or r.n_repeat_words or r.n_dup_lines or r.n_words > 1000 for r in beyond)


def test_odd_rows_as_the_sql_has_them(spark, same_as_sql, odd_dir):
    assert same_as_sql(quality.op4_quality_rules(spark, odd_dir), quality.OP4_SQL, odd_dir) > 200


def test_mcd_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1000, 100, (400, 5)).astype(int)
    x[:40] += 3000
    p = quality.mcd(spark.createDataFrame([("a", *map(int, r)) for r in x], STATS)).first()
    assert np.abs([p[f"m{i}"] - 1000 for i in range(5)]).max() < 60
    # The plain estimate of the rows that are left, with the floors on the diagonal.
    left = x[40:]
    want = np.linalg.cholesky(np.cov(left.T, bias=True) + np.diag(np.square(quality.FLOORS)))
    got = np.array([[p[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    assert np.abs(got - want).max() < 0.06 * want.max()


def test_small_groups_are_judged_by_a_larger_pool(spark):
    rng = np.random.default_rng(6)
    rows = [("en" if i < 300 else "xx", f"s{i % 50}", *map(int, r)) for i, r in enumerate(rng.normal(1000, 50, (320, 5)))]
    rows += [("en", "s1", 9000, 1000, 1000, 1000, 1000), ("xx", "s1", 1000, 9000, 1000, 1000, 1000), ("yy", "alone", 1000, 1000, 9000, 1000, 1000)]
    df = spark.createDataFrame([(i, *r, False) for i, r in enumerate(rows)], "doc_id long, lang string, source string, x1 long, x2 long, x3 long, x4 long, x5 long, base_failed boolean")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(got) == len(rows) and all(r.d2 is not None for r in got.values())
    assert [i for i in got if not got[i].kept] == [320, 321, 322]


def test_empty(spark, odd):
    assert quality.judged(quality.quality_statistics(odd.limit(0))).count() == 0
    assert quality.keep_quality(spark, odd).columns == odd.columns
