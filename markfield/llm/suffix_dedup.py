"""Operator 10: suffix-array dedup of repeated byte strings across documents.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id; strings are
judged on the input.  Suffix arrays (gsaca: linear grouping by Lyndon prefixes) decide which strings are equal; what
goes into them is found by anchors, exactly:

  1. Anchors.  Every window of `length` bytes has as anchor the leftmost GRAM-byte string in it with the smallest hash.
     Equal windows have equal anchors at equal offsets, so a repeated window is seen at an anchor that two documents
     share.
  2. Shared anchors.  Anchor keys are dealt to buckets; a bucket keeps the anchors that occur in two documents or more.
  3. Contexts.  The windows that have one anchor follow each other; the bytes they cover are its context.  Equal contexts
     of an anchor are one, with its smallest doc_id (they are aggregated, not decided).
  4. Suffix arrays over all contexts of every shared anchor: windows that are neighbours in the order and equal are one
     class, whose smallest document is that of its contexts.  A window goes from every document greater than that.

An anchor in more than HOT occurrences of a map task's share is dealt out window by window: each of its windows is a
context of its own in a bucket that its content names, so no bucket gathers all contexts of one anchor.  Documents
equal to one with a smaller doc_id are settled by their digest (128 bits and length).  Rows between the stages are
packed arrays; memory is bounded by a bucket, whose number grows with spark.sql.shuffle.partitions, and a document.

Defined cases: null text is empty; texts under `length` bytes lose nothing; rows with the same doc_id do not remove from
each other and are told apart by their texts; a null doc_id counts as larger than all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.gsaca import ranges, suffix_arrays
from markfield.llm.shared import cut, give_back, importable, settled, table, text_or_empty

LENGTH, GRAM, HOT = 50, 20, 50_000
#: Bytes of contexts whose suffix arrays are made together (more only if one anchor has more).
CHUNK = 1 << 20
NO_ID = 2**63 - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of every string of gram bytes, by doubling."""
    base = 0x9E3779B97F4A7C15
    h, have, out, done = a.astype(np.uint64) + np.uint64(1), 1, None, 0
    left = gram
    while True:
        if left & 1:
            if out is None:
                out, done = h, have
            else:
                n = len(a) - done - have + 1
                out = out[:n] * np.uint64(pow(base, have, 2**64)) + h[done : done + n]
                done += have
        left >>= 1
        if not left:
            return _mix(out)
        n = len(a) - 2 * have + 1
        h = h[:n] * np.uint64(pow(base, have, 2**64)) + h[have : have + n]
        have *= 2


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts that stand one after another in data (ends: their ends): start of the first window that has
    it, number of windows, the anchor's offset in the first, key.  In bounded segments; windows never cross a text's
    end.  (Runs that a segment cuts are two.)"""
    width, step = length - gram + 1, 1 << 19
    low20 = np.uint64(0xFFFFF)
    out = []
    for at in range(0, max(len(data) - length + 1, 0), step):
        part = data[at : at + step + length - 1]  # all windows that start in [at, at + step)
        h = gram_hashes(part, gram)
        low = _sliding((h & ~low20) | np.arange(len(h), dtype=np.uint64), width, np.minimum)  # hash, then place
        chosen = (low & low20).astype(np.int64)
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(part), "left")].tolist():
            chosen[max(0, e - at - length + 1) : max(0, e - at)] = -1  # these windows cross the end e
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        n = np.diff([*first, len(chosen)])
        ok = chosen[first] >= 0
        first, n = first[ok], n[ok]
        out.append((first + at, n, chosen[first] - first, h[chosen[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# Packed arrays: name, type and content of each, compressed together.


def _pack(**arrays: np.ndarray) -> bytes:
    head = ";".join(f"{n}:{a.dtype.str}:{len(a)}" for n, a in arrays.items()).encode()
    return zstandard.ZstdCompressor(1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for part in raw[4 : 4 + n].decode().split(";"):
        name, kind, count = part.split(":")
        out[name] = np.frombuffer(raw, np.dtype(kind), int(count), at)
        at += out[name].nbytes
    return out


def _batch(rows: list[tuple[int, bytes]], kind: int = 0) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["b", "kind", "blob"])


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places that belong to it."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(bucket[places[0]]), places


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, all bytes, offsets (one more than documents)."""
    col = batch["text"]
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64), data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _find_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, data, offsets = _texts(batch)
            p, windows, gram, k = anchors(data, offsets[1:])
            tag = np.array([xxhash.xxh32_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32)
            shape = (windows * 64 + gram).astype(np.uint16)
            of = np.searchsorted(offsets, p, "right") - 1
            place = (p - offsets[of]).astype(np.int64)
            bucket = (k >> np.uint64(16)) % np.uint64(buckets)
            rows = []
            for b, at in _split(bucket.astype(np.int64)):
                own, n = np.unique(of[at], return_counts=True)  # `at` keeps the order of documents
                key = k[at]
                rows.append((b, _pack(lo=key.astype(np.uint32), hi=(key >> np.uint64(32)).astype(np.uint16), doc=doc[own], tag=tag[own], n=n.astype(np.uint32), at=place[at].astype(np.uint32 if place.max() < 2**32 else np.uint64), shape=shape[at])))
            yield _batch(rows)

    return run


def _shared_anchors(buckets: int, hot: int):
    """Occurrences of anchors in two documents or more, packed for the documents' buckets."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in t["blob"].to_pylist()]
        key = np.concatenate([x["lo"].astype(np.uint64) | (x["hi"].astype(np.uint64) << np.uint64(32)) for x in parts])
        doc, tag = (np.concatenate([np.repeat(x[c], x["n"]) for x in parts]) for c in ("doc", "tag"))
        at, shape = (np.concatenate([x[c].astype(np.int64) for x in parts]) for c in ("at", "shape"))
        order = np.argsort(key, kind="stable")
        key, doc, tag, at, shape = key[order], doc[order], tag[order], at[order], shape[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff([*starts, len(key)])
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        keep = np.repeat(several, n)
        frequent = np.repeat(n > hot, n)[keep]
        doc, tag, at, shape = doc[keep], tag[keep], at[keep], shape[keep].astype(np.uint16)
        return pa.Table.from_batches([_batch([(b, _pack(doc=doc[i], tag=tag[i], at=at[i], shape=shape[i], hot=frequent[i])) for b, i in _split(_doc_bucket(doc, buckets))], 1)])

    return run


class _Documents:
    """The documents of a bucket and, by document, what other stages say about them."""

    def __init__(self, docs: pa.Table, told: pa.Table):
        self.doc: list[int] = []
        self.text: list[bytes] = []
        for blob in docs["blob"].to_pylist():
            x = _unpack(blob)
            raw, at = x["text"].tobytes(), 0
            for d, n in zip(x["doc"].tolist(), x["n"].tolist(), strict=True):
                self.doc.append(d)
                self.text.append(raw[at : at + n])
                at += n
        kinds, blobs = told["kind"].to_pylist(), told["blob"].to_pylist()
        self.copies = set()
        for k, blob in zip(kinds, blobs, strict=True):
            if k == 2:
                x = _unpack(blob)
                self.copies |= set(zip(x["doc"].tolist(), x["digest"].tolist(), strict=True))
        parts = [_unpack(b) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        self.told = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if parts else {}
        if parts:
            order = np.lexsort((self.told["at"], self.told["doc"]))
            self.told = {n: a[order] for n, a in self.told.items()}

    def of(self, k: int) -> dict[str, np.ndarray]:
        """What is told of document k: of rows with its doc_id and its text's tag."""
        if not self.told:
            return {}
        told, doc = self.told["doc"], self.doc[k]
        a, b = np.searchsorted(told, doc, "left"), np.searchsorted(told, doc, "right")
        if a == b:
            return {}
        own = self.told["tag"][a:b] == xxhash.xxh32_intdigest(self.text[k])
        return {n: x[a:b][own] for n, x in self.told.items()}

    def is_copy(self, k: int) -> bool:
        return bool(self.copies) and (self.doc[k], _digest(self.text[k])) in self.copies


def _digest(text: bytes) -> int:
    """64 bits of a document's digest, enough beside its doc_id."""
    return int.from_bytes(hashlib.md5(text).digest()[:8], "big", signed=True)


def _contexts(buckets: int):
    """Contexts of the shared anchors of documents that are no copies, packed for the anchors' buckets."""
    h = xxhash.xxh64_intdigest

    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        have = _Documents(docs, told)
        out: dict[str, list] = {"key": [], "doc": [], "tag": [], "from": [], "n": []}
        texts = []
        for k, doc in enumerate(have.doc):
            found = have.of(k)
            if not found or not len(found["at"]) or have.is_copy(k):
                continue
            text = have.text[k]
            tag = xxhash.xxh32_intdigest(text)
            for p, shape, hot in zip(found["at"].tolist(), found["shape"].tolist(), found["hot"].tolist(), strict=True):
                windows, gram = divmod(shape, 64)
                b = p + windows + LENGTH - 1
                if not hot:
                    out["key"].append(h(text[p + gram : p + gram + GRAM])), out["doc"].append(doc), out["tag"].append(tag), out["from"].append(p), out["n"].append(b - p)
                    texts.append(text[p:b])
                else:  # each window on its own; its content names the bucket
                    for x in range(p, p + windows):
                        w = text[x : x + LENGTH]
                        out["key"].append(h(w)), out["doc"].append(doc), out["tag"].append(tag), out["from"].append(x), out["n"].append(LENGTH)
                        texts.append(w)
        k = np.array(out["key"], np.uint64)
        doc, tag, start = np.array(out["doc"], np.int64), np.array(out["tag"], np.uint32), np.array(out["from"], np.int64)
        n = np.array(out["n"], np.uint8)
        rows = []
        for b, i in _split((k % np.uint64(buckets)).astype(np.int64)):
            rows.append((b, _pack(key=k[i], doc=doc[i], tag=tag[i], start=start[i], n=n[i], text=np.frombuffer(b"".join([texts[x] for x in i.tolist()]), np.uint8))))
        return pa.Table.from_batches([_batch(rows)])

    return run


def least_documents(flat: np.ndarray, ends: np.ndarray, groups: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of contexts, and the smallest document of a context that has the same window in the same
    group.  flat: bytes of the contexts, each followed by one more; ends: places of these; groups: their places in ends of
    each group's last context; doc: a document of every context.  One suffix array a group: equal windows are neighbours
    in its order."""
    codes = flat.astype(np.int64) + 2
    codes[ends] = 1
    last = ends[groups] + 1
    sa = suffix_arrays(codes, last)
    begins = np.concatenate([[0], ends[:-1] + 1])
    of = np.repeat(np.arange(len(ends)), ends + 1 - begins)
    fits = np.arange(len(flat)) + length <= ends[of]
    text = np.repeat(np.arange(len(last)), np.diff(np.concatenate([[0], last])))
    keep = fits[sa]
    order, text = sa[keep], text[keep]
    if not len(order):
        return order, order
    # Neighbours with different hashes are different; those with equal ones are compared.
    h = gram_hashes(flat, length)[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)
    same = np.flatnonzero(~new)
    for at in range(0, len(same), 1 << 18):  # bounded memory
        x = same[at : at + (1 << 18)]
        new[x] = (windows[order[x]] != windows[order[x - 1]]).any(1)
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(doc[of[order]], first), np.diff(np.append(first, len(order))))
    by_place = np.argsort(order)
    return order[by_place], least[by_place]


def _resolve(buckets: int):
    """Byte ranges that go, packed for the documents' buckets."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in t["blob"].to_pylist()]
        key, doc, tag, start, n = (np.concatenate([x[c] for x in parts]) for c in ("key", "doc", "tag", "start", "n"))
        raw = b"".join([x["text"].tobytes() for x in parts])
        ends = np.cumsum(n.astype(np.int64))
        order = np.argsort(key, kind="stable")  # a key's contexts one after another
        key, doc, tag, start, n, ends = (x[order] for x in (key, doc, tag, start, n, ends))
        # Equal contexts of a key are one, with its smallest document; keys of one document have nothing to remove.
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        shared = np.repeat(np.minimum.reduceat(doc, cuts) < np.maximum.reduceat(doc, cuts), np.diff(np.append(cuts, len(key)))) if len(key) else np.zeros(0, bool)
        key, doc, tag, start, n, ends = (x[shared] for x in (key, doc, tag, start, n, ends))
        known: dict[tuple[int, bytes], int] = {}
        own = np.array([known.setdefault((k, raw[e - m : e]), len(known)) for k, e, m in zip(key.tolist(), ends.tolist(), n.tolist(), strict=True)], np.int64)
        if not known:
            return pa.Table.from_batches([_batch([])])
        smallest = np.full(len(known), NO_ID, np.int64)
        np.minimum.at(smallest, own, doc)
        # Groups by their size, so that those of like size are sorted in step.
        texts = [x for _, x in known]
        size, keys = np.array([len(x) + 1 for x in texts]), np.array([k for k, _ in known], np.uint64)
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        order = np.lexsort((group, np.bincount(group, size)[group]))
        texts, smallest, size, group = [texts[i] for i in order.tolist()], smallest[order], size[order], group[order]
        own = np.argsort(order)[own]
        stops = np.cumsum(size) - 1
        groups = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)
        found, at = [], 0  # a few groups at a time: bounded memory
        for some in np.split(groups, np.flatnonzero(np.diff(stops[groups] // CHUNK)) + 1):
            end = some[-1] + 1
            origin = stops[at - 1] + 1 if at else 0
            flat = np.frombuffer(b"\0".join(texts[at:end]) + b"\0", np.uint8)
            p, q = least_documents(flat, stops[at:end] - origin, some - at, smallest[at:end])
            found.append((p + origin, q))
            at = end
        place, least = (np.concatenate(x) for x in zip(*found, strict=True))
        give_back()
        # A context's windows: with every document greater than the window's least they go; runs of them are ranges.
        of = np.searchsorted(stops, place)
        rows = np.argsort(own, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(known)))])
        out: list[tuple[np.ndarray, ...]] = []
        for all_but_smallest in (False, True):
            # In the smallest document a window goes if its least one is smaller; in the others each does that has one.
            gone = least <= smallest[of] if all_but_smallest else least < smallest[of]
            p, c = place[gone], of[gone]
            opens = np.concatenate([[True], (np.diff(p) > 1) | (c[1:] != c[:-1])]) if len(p) else np.zeros(0, bool)
            first = np.flatnonzero(opens)
            c, a, b = c[first], p[first], p[np.append(first[1:], len(p)) - 1] + LENGTH if len(p) else p
            origin = np.concatenate([[0], stops[:-1] + 1])[c]
            many = begin[c + 1] - begin[c]
            row = rows[ranges(begin[c], many)]
            run_ = np.repeat(np.arange(len(c)), many)
            wanted = (doc[row] > smallest[c[run_]]) == all_but_smallest
            row, run_ = row[wanted], run_[wanted]
            out.append((row, (a - origin)[run_], (b - origin)[run_]))
        r, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        d, s, w = doc[r], start[r], tag[r]
        return pa.Table.from_batches([_batch([(k, _pack(doc=d[i], tag=w[i], at=(s + a)[i], to=(s + b)[i])) for k, i in _split(_doc_bucket(d, buckets))], 1)])

    return run


def _finish(length: int, text_too: bool, once: bool):
    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        have = _Documents(docs, told)
        give_back()  # what unpacking took
        out: list[list] = [[] for _ in range(7)]
        seen: set[tuple[int, bytes]] = set()
        for k, doc in enumerate(have.doc):
            raw = have.text[k]
            if once:
                if (doc, raw) in seen:
                    continue
                seen.add((doc, raw))
            found = have.of(k)
            spans: list[list[int]] = []
            if len(raw) >= length and have.is_copy(k):
                spans = [[0, len(raw)]]
            elif found and len(found["at"]):
                for a, b in zip(found["at"].tolist(), np.minimum(found["to"], len(raw)).tolist(), strict=True):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    elif a < b:
                        spans.append([a, b])
            at, keep = 0, []
            for a, b in spans:
                keep.append(raw[at:a])
                at = b
            rest = b"".join([*keep, raw[at:]])
            for to, x in zip(out, (None if doc == NO_ID else doc, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if text_too else None, xxhash.xxh64_intdigest(raw, 42)), strict=True):
                to.append(x)
        out[6] = np.array(out[6], np.uint64).view(np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "h"])

    return run


PACKED = "b int, kind int, blob binary"


def dedup(docs: DataFrame, text_too: bool = False, once: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans long, kept_sha256 string, kept string (the remaining bytes as text, if
    asked for; bytes of characters that were cut are left out) and h long (xxhash64 of the text) of every row of docs
    (doc_id, text).  Rows with the same doc_id and text have the same result; `once` gives one row for all of them."""
    spark = docs.sparkSession
    importable(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().cast("binary").alias("text"))

    def packed_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, data, offsets = _texts(batch)
            rows = []
            for b, i in _split(_doc_bucket(doc, buckets)):
                text = np.concatenate([data[offsets[x] : offsets[x + 1]] for x in i.tolist()])
                rows.append((b, _pack(doc=doc[i], n=(offsets[i + 1] - offsets[i]).astype(np.int64), text=text)))
            yield _batch(rows)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [hashlib.md5(x.as_buffer()).digest() for x in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array([int.from_bytes(x[:8], "big", signed=True) for x in d], pa.int64()), pa.array([int.from_bytes(x[8:], "big", signed=True) for x in d], pa.int64())], ["doc_id", "digest", "more"])

    def packed_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, digest = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "digest"))
            yield _batch([(b, _pack(doc=doc[i], digest=digest[i])) for b, i in _split(_doc_bucket(doc, buckets))], 2)

    @settled()
    def copies() -> DataFrame:
        seen = cut(docs.mapInArrow(digests, "doc_id long, digest long, more long"))
        classes = seen.groupBy("digest", "more").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        return seen.join(classes, ["digest", "more"]).where("doc_id > first").select("doc_id", "digest").mapInArrow(packed_copies, PACKED)

    @settled()
    def repeated() -> DataFrame:
        shared = cut(docs.mapInArrow(_find_anchors(buckets), PACKED).groupBy("b").applyInArrow(_shared_anchors(buckets, hot), PACKED))
        contexts = by.groupBy("b").cogroup(shared.unionByName(known).groupBy("b")).applyInArrow(_contexts(buckets), PACKED)
        return contexts.groupBy("b").applyInArrow(_resolve(buckets), PACKED)

    known, by = copies(), docs.mapInArrow(packed_docs, PACKED)
    ranges = repeated()
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, h long"
    return by.groupBy("b").cogroup(ranges.unionByName(known).groupBy("b")).applyInArrow(_finish(LENGTH, text_too, once), schema)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept", "h")
