"""Whole packings against best-fit decreasing and, where small, against all packings."""

import random
from collections import Counter
from functools import cache

import pytest

from markfield.llm import packing

SKEWED = {1126: 120, 819: 120, 717: 180, 614: 60, 307: 60}


def sequences(plan, hist, capacity):
    used = {}
    for often, items in plan:
        assert often > 0 and sum(n * k for n, k in items) <= capacity
        for n, k in items:
            used[n] = used.get(n, 0) + often * k
    assert used == hist
    return sum(often for often, _ in plan)


def plain_best_fit(hist, capacity):
    rooms = []
    for x in sorted(hist, reverse=True):
        for _ in range(hist[x]):
            fit = [i for i, r in enumerate(rooms) if r >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(capacity - x)
    return len(rooms)


def fewest(hist, capacity):
    """Fewest sequences by trying every sequence for every piece."""
    pieces = tuple(x for x in sorted(hist, reverse=True) for _ in range(hist[x]))

    @cache
    def fits(i, rooms):
        return i == len(pieces) or any(fits(i + 1, tuple(sorted((*rooms[:k], r - pieces[i], *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= pieces[i])

    n = 1
    while not fits(0, (capacity,) * n):
        n += 1
    return n


@pytest.mark.parametrize("scale", [1, 1000])
def test_skewed_histogram(scale):
    hist = {x: c * scale for x, c in SKEWED.items()}
    assert plain_best_fit(SKEWED, 2048) == 210
    assert sequences(packing.plan(hist), hist, 2048) <= 210 * scale


def test_never_worse_than_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        hist = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 7))}
        lengths = sorted(hist, reverse=True)
        plain = plain_best_fit(hist, 64)
        assert sequences(packing.best_fit(lengths, [hist[x] for x in lengths], 64), hist, 64) == plain
        n = sequences(packing.plan(hist, 64), hist, 64)
        assert packing.sequences_needed(lengths, [hist[x] for x in lengths], 64) <= n <= plain


def test_fewest_on_small_histograms():
    rng = random.Random(3)
    for _ in range(80):
        hist = {rng.randint(3, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        assert sequences(packing.plan(hist, 40), hist, 40) == fewest(hist, 40), hist
    assert packing.plan({}) == []


def test_long_histogram_is_at_the_bound_without_a_search(monkeypatch):
    def search(*_):
        raise AssertionError("states of the search cost the driver minutes on such histograms")

    rng = random.Random(9)
    hist = dict(Counter(min(2048, int(rng.lognormvariate(5.5, 0.5))) for _ in range(50_000)) + Counter({308: 3500}))
    monkeypatch.setattr(packing, "fillings", search)
    lengths = sorted(hist, reverse=True)
    assert sequences(packing.plan(hist), hist, 2048) == packing.sequences_needed(lengths, [hist[x] for x in lengths], 2048)


def test_fullest_keeps_short_pieces():
    rng = random.Random(4)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 6)), reverse=True)
        counts, room = [rng.randint(0, 3) for _ in lengths], rng.randint(0, 90)
        all_ = [()]
        for c in counts:
            all_ = [(*f, k) for f in all_ for k in range(c + 1)]
        worth = lambda f: (sum(x * k for x, k in zip(lengths, f, strict=True)), min((x for x, k in zip(lengths, f, strict=True) if k), default=0))
        found = dict(packing.fullest(lengths, counts, room))
        assert worth([found.get(i, 0) for i in range(len(lengths))]) == max(w for w in map(worth, all_) if w[0] <= room)
        assert all(0 < k <= counts[i] for i, k in found.items())


def test_bound_sees_lengths_that_waste():
    assert packing.sequences_needed(sorted(SKEWED, reverse=True), [SKEWED[x] for x in sorted(SKEWED, reverse=True)], 2048) == 210
    assert packing.sequences_needed([308], [50_000], 2048) == 8334
    rng = random.Random(6)
    for _ in range(60):
        hist = {rng.randint(3, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        lengths = sorted(hist, reverse=True)
        assert packing.sequences_needed(lengths, [hist[x] for x in lengths], 40) <= fewest(hist, 40)


@pytest.mark.parametrize("share", [packing.SHARE, 3, 40])
def test_pieces_of_a_hot_length_fill_the_planned_slots(spark, share):
    rng = random.Random(5)
    lengths = [700] * 300 + [rng.randint(1, 2048) for _ in range(200)]
    rows = [(None if i % 50 == 0 else i % 90, i % 3, n, i % 7) for i, n in enumerate(lengths)]
    made = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long").selectExpr("*", "1 as part", "2 as kind", "3 as r", "4 as s")
    got = packing.pack(made, share=share).collect()
    assert sorted(tuple(r)[:3] for r in got if r.doc_id is not None) == sorted(r[:3] for r in rows if r[0] is not None) and len(got) == len(rows)
    hist = {x: lengths.count(x) for x in lengths}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(sequences) == sum(n for n, _ in packing.plan(hist))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and s[-1][0] + s[-1][1] <= 2048
