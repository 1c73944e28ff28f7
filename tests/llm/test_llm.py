"""Operators on small inputs with nulls, empty and long texts, ties and repeated rows, against brute force."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from conftest import SMALL
from fixtures import DOCS

from markfield.llm import gsaca, licenses, line_dedup, packing, pieces, quality, queries, simhash, suffix_dedup


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, same_as_sql, name):
    assert same_as_sql(queries.QUERIES[name](spark, SMALL), queries.SQL[name]) > 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 50))]
        assert gsaca.suffix_array(a) == sorted(range(len(a)), key=lambda i: a[i:])
    assert gsaca.suffix_array([]) == []


@pytest.mark.parametrize(("long", "step"), [(gsaca.LONG, gsaca.STEP), (20, 50)])
def test_suffix_arrays_of_many_texts(monkeypatch, long, step):
    monkeypatch.setattr(gsaca, "LONG", long)
    monkeypatch.setattr(gsaca, "STEP", step)
    rng = random.Random(7)
    for _ in range(100):
        texts = [[rng.randint(1, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(1, 12))]
        ends = np.cumsum([len(t) for t in texts])
        want = [e - len(t) + i for t, e in zip(texts, ends.tolist(), strict=True) for i in sorted(range(len(t)), key=lambda i: t[i:])]
        assert gsaca.suffix_arrays(np.concatenate([np.array(t) for t in texts]), ends).tolist() == want


def test_suffix_arrays_decide_what_goes(spark):
    passage = "this passage of more than fifty bytes stands in each of the documents here, "
    docs = spark.createDataFrame([(i, f"{i} {passage * 2}{i}", "", "", 0) for i in range(5)], DOCS)
    assert sum(r.n_removed for r in suffix_dedup.dedup(docs).collect()) >= 4 * 2 * len(passage)
    places, least = suffix_dedup.least_documents(np.frombuffer(b"abcabcab.bcabca.", np.uint8), np.array([8, 15]), np.array([1]), np.array([3, 1]), 3)
    assert dict(zip(places.tolist(), least.tolist(), strict=True)) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 1, 10: 1, 11: 1, 12: 1}


def brute_repeats(docs, n=50):
    first, out = {}, {}
    key = lambda i: suffix_dedup.NO_ID if i is None else i
    for i, t in docs:
        for p in range(len(t) - n + 1):
            first[t[p : p + n]] = min(first.get(t[p : p + n], key(i)), key(i))
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < key(i):
                gone[p : p + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        rest = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.setdefault(i, set()).add((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT])
def test_suffix_dedup(spark, odd, hot):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(120))
    rows = [(i, "".join(rng.choice("uvwxyz é") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 30) : rng.randint(60, 120)] * rng.randint(0, 2), "", "", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    want = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    got = suffix_dedup.dedup(docs, hot=hot).collect()
    assert len(got) == docs.count()
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id] for r in got)
    assert sum(r.n_removed for r in got) > 500


def brute_components(fps, distance=4):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= distance) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash(spark, odd):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = [b for b in base] + [base[rng.randrange(20)] ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) for _ in range(200)]
    fps = sorted(set(f & (2**64 - 1) for f in fps))
    nodes = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "node long, fp long")
    want = brute_components(fps)
    from markfield.llm.components import components

    for block in (simhash.BLOCK, 8):  # also with cells dealt out as pairs of blocks
        simhash.BLOCK, before = block, simhash.BLOCK
        got = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
        simhash.BLOCK = before
        assert [got.get(i, i) for i in range(len(fps))] == want
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.fp for r in rows if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}


def test_near_duplicate_representatives(spark):
    far = [" ".join(f"{x}{i}" for i in range(80)) for x in "pqrs"]
    rows = [(3, far[0]), (2, far[0]), (2, far[0]), (2, far[1]), (None, far[2]), (None, far[2]), (None, far[3]), (7, far[3]), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(docs).collect()), key=str)
    assert kept == sorted([(2, far[0]), (2, far[1]), (None, far[2]), (7, far[3]), (8, None)], key=str)
    seen = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [c for (i, _), c in seen.items() if i is None and c is not None] == [7] and set(seen.values()) == {2, None, 7, 8}


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for r in odd.collect():
        assert own.encode(r.text or "") == array("I", t.encode(r.text or "", add_special_tokens=False).ids).tobytes()
    cut = packing.pieces(odd, path, capacity=64)
    got = packing.pack(cut, capacity=64).collect()
    assert len(got) == cut.count()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = 0
        for offset, length in sorted(b):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert zlib.crc32(b"\0\0\0\0") in {r.ids_crc32 for r in got if r.length == 1}
    for seed in range(5):  # as few as the bound on small histograms
        rng = random.Random(seed)
        hist = {rng.randint(1, 60): rng.randint(1, 40) for _ in range(20)}
        plan = packing.plan(hist, 64)
        assert all(sum(n * k for n, k in items) <= 64 for _, items in plan)
        used = {}
        for often, items in plan:
            for n, k in items:
                used[n] = used.get(n, 0) + often * k
        assert used == hist


def test_pieces(spark, odd):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = public_tokenizers.path("piece_bpe_32k.model")
    c = pieces.PieceCodec(path)
    model = proto.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    other = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(other.get_score(i) for i in ids)
    told = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()
    for w in {w for r in told for w in (r.text or "").split()}:
        a, b = list(c.encode(w)), other.encode(w)
        assert a == b or score(a) >= score(b)
    rows = pieces.encode(odd, path).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    back = {r.text for r in pieces.decode(pieces.encode(odd, path), path).collect()}
    assert back == {r.text or "" for r in odd.collect()}


def test_native_operators_on_odd_rows(spark, odd):
    assert licenses.scan(odd).where("labels = 'mit'").count() == 1
    kept = line_dedup.dedup_lines(odd).collect()
    assert len(kept) == odd.count()
    assert [r.text for r in kept if r.doc_id == 99] == [""]
    stats = quality.quality_statistics(odd)
    assert stats.count() == odd.count() and quality.judged(stats).where("kept is null").count() == 0
    empty = odd.limit(0)
    for f in (licenses.scan, line_dedup.dedup_lines, simhash.near_duplicates, suffix_dedup.dedup, lambda d: quality.judged(quality.quality_statistics(d)), lambda d: packing.pack(packing.pieces(d, __import__("public_tokenizers").path("word_bpe_49k.json")))):
        assert f(empty).count() == 0


def test_completion_is_exact():
    rng = random.Random(1)
    for _ in range(500):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 7)), reverse=True)
        counts, room = [rng.randint(0, 3) for _ in lengths], rng.randint(0, 90)
        sums = {0}
        for x, c in zip(lengths, counts, strict=True):
            sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= room}
        found = packing.completion(lengths, counts, room, 10**6)
        assert sum(lengths[i] * n for i, n in found) == max(sums) and all(n <= counts[i] for i, n in found)


def test_simhash_broadcasts_nothing_of_size(spark, monkeypatch):
    from markfield.llm import shared, simhash

    docs = spark.createDataFrame([(i, f"one two three four {i % 7} {i % 5}") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(shared, "BROADCAST", 0)
    out = simhash.near_duplicates(docs)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, out.collect())) == want
