"""Keyed store, manifests, and results of several micro-batches."""

import hashlib
import json

import pytest

from markfield.sources import manifest
from markfield.sources.store import JobStore, limit_reason, new_ids
from markfield.streaming.queue import keep_results, read_results

FILES = "id string, at int, name string, type string, content binary"


def test_store(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "job"))
    assert store.load_batch() is None and store.load_result("a") is None and store.restore() is None and store.summary() == {"used": 0, "quota": None, "free": None}
    files = spark.createDataFrame([("a", 0, "a.png", "image/png", bytearray(b"11")), ("b", 1, "b.png", None, bytearray(b"2"))], FILES)
    assert store.save_batch(files) == {"saved": True, "bytes": 3}
    many = spark.range(41).selectExpr("cast(id as string) id", "cast(id as int) at", "'n' name", "'t' type", "cast('x' as binary) content")
    assert store.save_batch(many) == {"saved": False, "reason": "超过 40 张"}  # the batch before stays
    assert [r.id for r in store.load_batch().collect()] == ["a", "b"]
    result = lambda *rows: spark.createDataFrame([(i, s, bytearray(c)) for i, s, c in rows], "id string, status string, content binary")
    store.save_results(result(("a", "done", b"one"), ("b", "unchanged", b"two")))
    store.save_results(result(("a", "done", b"again")))
    assert bytes(store.load_result("a")["content"]) == b"again" and store.results().count() == 2
    store.delete_results(spark.createDataFrame([("b",)], "id string"))
    assert store.load_result("b") is None and [(r.id, r.status) for r in store.restore().collect()] == [("a", "done"), ("b", "pending")]
    store.compact()
    assert [r.id for r in store.results().collect()] == ["a"] and store.summary()["used"] > 0
    store.save_results(result(("b", "done", b"new")))
    assert store.results().count() == 2
    store.clear()
    assert store.results() is None and store.load_batch() is None


def test_limits(spark, tmp_path):
    assert limit_reason(40, 220 << 20) == "" and limit_reason(41, 0) == "超过 40 张" and limit_reason(1, (220 << 20) + 1) == "原图超过 220MB"
    with pytest.raises(OSError):
        JobStore(spark, str(tmp_path / "small"), quota=1000).save_batch(spark.createDataFrame([("a", 0, "a", None, bytearray(b"x"))], FILES))
    ids = [r.id for r in new_ids(spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "id string, n int")).collect()]
    assert ids[0] == "a" and len({*ids}) == 3 and None not in ids


def test_manifest(spark, tmp_path):
    parts = [b"0123", b"45", b"6789ab"]
    for model, sha in (("good", hashlib.sha256(b"".join(parts)).hexdigest()), ("bad", "0" * 64), ("short", None)):
        (tmp_path / model).mkdir()
        told = {"totalSize": 12 if model != "short" else 13, "chunks": [{"file": f"{model}.{k}", "size": len(p)} for k, p in enumerate(parts)]}
        (tmp_path / model / "manifest.json").write_text(json.dumps(told | ({"sha256": sha} if sha else {}), indent=1))
    read = manifest.read_manifest(spark, str(tmp_path / "*" / "manifest.json"))
    assert [(r.file, r.offset) for r in read.where("model = 'good'").orderBy("idx").collect()] == [("good.0", 0), ("good.1", 4), ("good.2", 6)]
    contents = spark.createDataFrame([(f"{m}.{k}", bytearray(p)) for m in ("good", "bad", "short") for k, p in enumerate(parts)], "file string, content binary")
    assert {r.model: (r.size, r.ok) for r in manifest.verified(read, contents).collect()} == {"good": (12, True), "bad": (12, False), "short": (12, False)}
    assert {r.model: r.ok for r in manifest.verified(read, contents.where("file <> 'good.1'")).collect()}["good"] is False
    lengths = contents.selectExpr("file", "case when file = 'bad.2' then 5 else length(content) end as length")
    assert {r.model: (r.have, r.total) for r in manifest.coverage(read, lengths).collect()} == {"good": (3, 3), "bad": (2, 3), "short": (3, 3)}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "manifest.json").write_text("{}")
    with pytest.raises(Exception, match="not a manifest"):
        manifest.read_manifest(spark, str(tmp_path / "none" / "manifest.json")).collect()


def test_a_key_of_two_batches_is_kept_once(spark, tmp_path):
    source = tmp_path / "in"
    for status in ("first", "second"):
        spark.createDataFrame([("a", status), (status, status)], "id string, status string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("id string, status string").json(str(source)).selectExpr("id", "status", "current_timestamp() as saved_at")
        keep_results(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert {(r.id, r.status) for r in read_results(spark, str(tmp_path / "out")).collect()} == {("a", "second"), ("first", "first"), ("second", "second")}
