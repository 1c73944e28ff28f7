"""The pipeline's near-duplicates against all pairs of shingle sets."""

import random

from conftest import SMALL

from markfield.llm import shingles, stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Of each component of pairs with 5-word Jaccard of 0.8 or more the smallest doc_id."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(rows)))
    near = lambda a, b: a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    groups = {}
    for (i, _), g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(i)
    return sorted(min(g) for g in groups.values())


def edited(rng, words, n):
    words = words.copy()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_pairs_beyond_four_bits(spark):
    rng = random.Random(7)
    common = [f"c{rng.randrange(50)}" for _ in range(60)]
    rows = [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "one two three")]
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 200))] + common * (g % 2)
        rows += [(g * 10 + k, edited(rng, base, k * len(base) // 150)) for k in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want = brute(rows)
    assert 30 < len(want) < 140
    got = sorted(r.doc_id for r in stages.simhash_dedup(spark, docs, SMALL).collect())
    assert got == want


def test_small_tables_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in shingles.representatives(docs).collect()) == want


def test_rows_without_ids(spark):
    far = [" ".join(f"{x}{i}" for i in range(80)) for x in "pqrs"]
    rows = [(3, far[0]), (2, far[0]), (2, far[0]), (2, far[1]), (None, far[2]), (None, far[2]), (None, far[3]), (7, far[3]), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in shingles.representatives(docs).collect()), key=str)
    assert kept == sorted([(2, far[0]), (2, far[1]), (None, far[2]), (7, far[3]), (8, None)], key=str)
    assert shingles.representatives(docs.limit(0)).count() == 0


def test_simhash_is_a_step(spark, monkeypatch):
    # Without the join that follows, the step by fingerprints links what is within its distance, and nothing that is unlike.
    rng = random.Random(3)
    rows = []
    for g in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows += [(g * 10, " ".join(base)), (g * 10 + 1, " ".join([*base[:-1], "other"])), (g * 10 + 2, edited(rng, base, 90))]
    rows += [(900, None), (901, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    enough, joined = shingles._enough, {}
    monkeypatch.setattr(shingles, "_enough", lambda pairs: enough(pairs).limit(0))
    joined["alone"] = sorted(r.doc_id for r in stages.simhash_dedup(spark, docs, SMALL).collect())
    monkeypatch.setattr(shingles, "_enough", enough)
    joined["all"] = sorted(r.doc_id for r in stages.simhash_dedup(spark, docs, SMALL).collect())
    assert joined["all"] == brute(rows) and set(joined["all"]) <= set(joined["alone"])
    assert len(rows) - len(joined["alone"]) >= 6


def test_fingerprint_by_bits():
    s = shingles.shingles("some text of more than five words, and then some more of it")
    bits = [sum((int(x) >> k) & 1 for x in s) for k in range(64)]
    assert shingles.fingerprint(s) % 2**64 == sum(1 << k for k, c in enumerate(bits) if 2 * c > len(s))
    assert shingles.fingerprint(s[:0]) == 0
