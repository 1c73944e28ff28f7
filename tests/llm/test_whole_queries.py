"""Queries without SQL, whole, against plain versions: op3 (quadratic Viterbi over whole texts), op6 (all pairs of
fingerprints by definition), op9 (the tokenizer itself, sequences without gaps)."""

import random
import zlib
from array import array

import pytest
import xxhash
from conftest import SMALL

from markfield.llm import packing, pieces, queries


def texts(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def plain_ids(text, known, byte_id, least):
    """Best path over a whole text: every piece at every place, the longer one on equal scores."""
    if not text:
        return []
    s = " " + text
    most = max(map(len, known))
    score, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - most), e):
            if (p := known.get(s[a:e])) and score[a] + p[0] > score[e]:
                score[e], back[e] = score[a] + p[0], (a, [p[1]])
        if s[e - 1] not in known and score[e - 1] + least > score[e]:
            score[e], back[e] = score[e - 1] + least, (e - 1, [byte_id[b] for b in s[e - 1].encode()])
    out, e = [], len(s)
    while e:
        a, ids = back[e]
        out[:0] = ids
        e = a
    return out


def test_op3(spark, odd_dir):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known, byte_id = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            known[sp.id_to_piece(i).replace(pieces.MARK, " ")] = (sp.get_score(i), i)
    least = min(s for s, _ in known.values()) - pieces.UNKNOWN_PENALTY
    told = sorted(set(texts(spark, odd_dir)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    told = [r for r in told if len(r[1]) < 30_000]
    want = {}
    for doc, text in told:
        ids = plain_ids(text, known, byte_id, least)
        want.setdefault(doc, set()).add((len(ids), sum(i in byte_id.values() for i in ids), zlib.crc32(array("I", ids).tobytes())))
    rows = queries.QUERIES["op3_sentencepiece"](spark, odd_dir).collect()
    assert all(r.round_trip for r in rows)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.n_byte_tokens, r.ids_crc32))
    assert len(want) > 200 and all(want[d] <= got[d] for d in want)
    assert queries.QUERIES["op3_sentencepiece"](spark, odd_dir).limit(0).count() == 0
    assert pieces.encode(spark.read.parquet(f"{SMALL}/documents.parquet").limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op6(spark, odd_dir):
    told = texts(spark, odd_dir)
    prints = {t: plain_fingerprint(t) for _, t in told}
    nodes = sorted(set(prints.values()))
    label = {n: n for n in nodes}
    while True:
        new = {n: min(label[m] for m in nodes if (n ^ m).bit_count() <= 4) for n in nodes}
        if new == label:
            break
        label = new
    least = {}
    for d, t in told:
        if d is not None:
            least[label[prints[t]]] = min(least.get(label[prints[t]], d), d)
    want = sorted(repr((d, f"{prints[t]:016x}", least.get(label[prints[t]]))) for d, t in told)
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op6_simhash_near_dedup"](spark, odd_dir).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_op9(spark, odd_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text in texts(spark, odd_dir):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want.append((d, k, a, len(ids[a : a + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a : a + 2048]))))
    rows = queries.QUERIES["op9_best_fit_packing"](spark, odd_dir).collect()
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == sorted(map(repr, want))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and s[-1][0] + s[-1][1] <= 2048
    hist = {}
    for r in want:
        hist[r[3]] = hist.get(r[3], 0) + 1
    lengths = sorted(hist, reverse=True)
    assert len(sequences) == packing.sequences_needed(lengths, [hist[x] for x in lengths], 2048)  # as few as any packing


def fewest(lengths, capacity):
    """Exhaustive: each piece into each sequence with another room, or a new one."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= order[i]}:
            k = rooms.index(room)
            go(i + 1, [*rooms[:k], room - order[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - order[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(3))
def test_op9_plan_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    cases = [[rng.randint(150, 1300) for _ in range(rng.randint(3, 9))] for _ in range(1000)]
    for lengths in [*cases, [1122, 804, 702, 315, 618, 843, 595, 863]]:
        hist = {x: lengths.count(x) for x in lengths}
        plan = packing.plan(hist)
        assert sum(n for n, _ in plan) == fewest(lengths, 2048)
        assert all(sum(x * k for x, k in items) <= 2048 for _, items in plan)


def test_op9_plan_is_never_worse_than_best_fit():
    rng = random.Random(9)
    for n in (30, 100, 300):
        for _ in range(6):
            hist = {rng.randint(1, 2048): rng.choice([1, 1, 1, 2, 500]) for _ in range(n)}
            lengths = sorted(hist, reverse=True)
            plan = packing.plan(hist)
            assert sum(k for k, _ in plan) <= sum(k for k, _ in packing.best_fit(lengths, [hist[x] for x in lengths], 2048))
            used = {}
            for often, items in plan:
                for x, k in items:
                    used[x] = used.get(x, 0) + often * k
            assert used == hist
