"""Every stage of the corpus pipeline on its own input against a plain version, on the small documents and odd rows."""

import hashlib
import zlib
from array import array

import duckdb
import pytest
import xxhash
from conftest import SMALL

import corpus_pipeline
from markfield.llm.line_dedup import OP1_SQL
from markfield.llm.quality import OP4_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sql_over(path, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    return con.execute(sql).fetchall()


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, distance=4):
    """Places that link, transitively."""
    rest, out = set(range(len(fps))), []
    while rest:
        todo, group = [rest.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in rest if (fps[i] ^ fps[j]).bit_count() <= distance}
            rest -= near
            todo += near
        out.append(group)
    return out


def plain_removal(docs, n=50):
    """doc_id -> bytes that stay; doc_ids are distinct."""
    first = {}
    for i, t in sorted(docs.items()):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p : p + n], i)
    out = {}
    for i, t in docs.items():
        stay, until = bytearray(), 0
        for p in range(len(t)):
            if p <= len(t) - n and first[t[p : p + n]] < i:
                until = p + n
            if p >= until:
                stay.append(t[p])
        out[i] = bytes(stay)
    return out


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The paths of documents and of every stage's output."""
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "one two three", None, "s", 13)]
    top = tmp_path_factory.mktemp("pipeline")
    paths = [f"{top}/in"]
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    small.unionByName(spark.createDataFrame(odd, DOCS).select(small.columns)).write.parquet(paths[0])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, spark.read.parquet(paths[-1]), SMALL).write.parquet(f"{top}/{name}")
        paths.append(f"{top}/{name}")
    return paths


def rows(spark, path):
    return spark.read.parquet(path).collect()


def test_columns(spark, run):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for path in run[1:-1]:
        assert spark.read.parquet(path).dtypes == spark.read.parquet(run[0]).dtypes


def test_quality(spark, run):
    kept = {r[0] for r in sql_over(run[0], f"select doc_id from ({OP4_SQL}) where kept")}
    want = sorted(str(r) for r in rows(spark, run[0]) if r.doc_id in kept)
    assert 0 < len(want) < len(rows(spark, run[0])) and sorted(map(str, rows(spark, run[1]))) == want


def test_lines(spark, run):
    want = sorted(sql_over(run[1], f"select doc_id, kept_sha256 from ({OP1_SQL})"))
    got = rows(spark, run[2])
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    before = {r.doc_id: r.text for r in rows(spark, run[1])}
    assert any(before[r.doc_id] != r.text for r in got)


def test_near_duplicates(spark, run):
    docs = rows(spark, run[2])
    found = groups([plain_fingerprint(r.text or "") for r in docs])
    want = sorted(str(min((docs[i] for i in g), key=lambda r: r.doc_id)) for g in found)
    assert len(want) < len(docs) and sorted(map(str, rows(spark, run[3]))) == want


def test_repeats(spark, run):
    want = plain_removal({r.doc_id: (r.text or "").encode() for r in rows(spark, run[3])})
    got = rows(spark, run[4])
    assert sum(map(len, want.values())) < sum(len((r.text or "").encode()) for r in rows(spark, run[3]))
    # Cuts are at bytes; a character that lost some of its bytes cannot stand in a string column.
    assert len(got) == len(want)
    assert all(r.text.encode() == want[r.doc_id].decode("utf-8", "ignore").encode() or r.text == want[r.doc_id].decode("utf-8", "replace") for r in got)


def test_packing(spark, run):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = [], 0
    for r in rows(spark, run[4]):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(array("I", part).tobytes())))
    got = rows(spark, run[5])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 2048
    assert len(bins) <= -(-total // 2048) + 1
