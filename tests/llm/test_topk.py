"""Exact top-k against all scores, with components beyond 64 bits, repeated ids, several widths and small blocks."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from markfield.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, mod=20):
    ok = [(i, [math.floor(Fraction(e) * 64) for e in x]) for i, x in rows if i is not None and x is not None and all(e is not None and math.isfinite(e) for e in x)]
    out = set()
    for q in {i for i, _ in ok if i % mod == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in ok if i == q for j, y in ok if j != q and len(x) == len(y))
        out |= {(q, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


def odd_rows():
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(130)]
    rows += [(5, [0.5] * 8), (20, [0.3] * 8), (20, [0.3] * 8), (203, [0.25] * 8), (204, [0.25] * 8)]  # repeated ids and ties
    rows += [(700, None), (701, [math.nan] * 8), (702, [None] * 8), (None, [0.1] * 8), (703, [math.inf, 1.0])]
    rows += [(400, []), (401, []), (440, [1.0, 2.0]), (441, [1.0, -2.0])]  # other widths
    return rows + [(600, [1e300, *[1.0] * 7]), (601, [1e16, *[-1.0] * 7]), (620, [-1e300] * 8), (640, [1e17] * 8)]


@pytest.mark.parametrize(("block", "many"), [(topk.BLOCK, topk.QUERIES), (40, 4)])
def test_same_as_all_scores(spark, block, many):
    rows = odd_rows()
    v = topk.finite(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L as n", "2L as i", "'x' as block", "3 as x"))
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 7, block=block, many=many).collect()]
    want = brute(rows, 7)
    assert len(got) == len(want) and set(got) == want


def test_blocks_out_of_reach_are_left_out(spark):
    rng = random.Random(5)
    axes = [[8.0 * (d == a) for d in range(8)] for a in range(8)]
    rows = [(i, [x + rng.uniform(-0.2, 0.2) for x in axes[i % 8]]) for i in range(400)]
    v = topk.finite(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), 5, block=50, many=4).collect()}
    assert got == brute(rows, 5)
    x = np.array([[math.floor(64 * e) for e in r[1]] for r in rows])
    apart = topk.bounds(x[:1], x[1::8].min(0), x[1::8].max(0))
    assert apart[0] < sorted(x[8::8] @ x[0])[-5]  # another axis' block cannot reach the fifth best


def test_empty(spark):
    v = topk.finite(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(v, v).count() == 0
