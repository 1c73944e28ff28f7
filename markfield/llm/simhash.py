"""Operator 6: SimHash near-duplicates by segment-popcount embedding.

Fingerprints: 64 bits, set where over half of the shingles' XXH64 values have the bit.  Distinct fingerprints are
embedded as the bit counts of 32 two-bit segments; the Manhattan distance of two embeddings is at most the Hamming
distance of the fingerprints.  Grid range-join: the segments form m groups; two fingerprints within `distance` differ
in at most `distance` groups, so at least r = m - distance of them have Manhattan distance 0, and the pair meets in the
grid cell of one of the C(m, r) choices of r groups.  In a cell, pairs beyond the Manhattan bound are dropped, the rest
is verified by exact Hamming distance.  The join is exact for any m; m only sets cell sizes and is taken from the
number of distinct fingerprints.

Cells give no pairs but a spanning forest of their links (links of a cell are at most its members less one), in
bounded blocks: a cell of more than BLOCK fingerprints is dealt out as pairs of blocks, each its own group, so no task
holds more than 2 * BLOCK fingerprints of a cell and a hot cell is spread over tasks.  Copies share a fingerprint and
take part once.  Components of the links are found by distributed rounds.

Defined cases: null text has no words; without words the fingerprint is zero, and it links like any other; texts of
fewer words than a shingle are one shingle; repeated rows give a row each; rows with one doc_id and different texts are
linked by their texts only; null doc_id rows link like any other and take component_id from the other members (null if
none has a doc_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.components import components
from markfield.llm.shared import cut, dealt, table, text_or_empty

SEGMENTS, BLOCK = 32, 2048


def fingerprint(text: str, width: int = 4) -> int:
    """bytes.lower and bytes.split are exactly the contract's case folding (A-Z) and word separators."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, h = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        stops, starts = (ends[width - 1 :] - 1).tolist(), [0, *ends[: len(words) - width].tolist()]
        hashes = [h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    count, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * count > n))


def fingerprints(docs: DataFrame, width: int = 4, *keep: str) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits as a signed integer) of every row, and the long columns `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b["text"]], dtype=np.uint64)
            yield pa.record_batch([b["doc_id"], pa.array(fps.view(np.int64)), *(b[c] for c in keep)], ["doc_id", "fp", *keep])

    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *keep).mapInArrow(run, schema)


def groups_for(n: int, distance: int) -> int:
    """Segment groups m so that cells stay small among n fingerprints: about 1.4 bits a segment in m - distance of m
    groups should exceed log2(n) - 3."""
    for m in range(distance + 1, 2 * distance + 1):
        if 1.4 * SEGMENTS * (m - distance) / m >= np.log2(max(n, 2)) - 3:
            return m
    return 2 * distance


def _embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, one a byte."""
    bits = np.unpackbits(fp.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def _cells(nodes: DataFrame, distance: int, m: int) -> DataFrame:
    """node, fp, cell long of every choice of groups."""
    bounds = np.linspace(0, SEGMENTS, m + 1).astype(int)
    choices = list(combinations(range(m), m - distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = (b[c].to_numpy(zero_copy_only=False) for c in ("node", "fp"))
            e = _embedding(fp).astype(np.uint64)
            keys = []
            for g in range(m):  # base-3 number of a group's counts; 32 segments fit in 51 bits
                k = np.zeros(len(fp), np.uint64)
                for s in range(bounds[g], bounds[g + 1]):
                    k = k * np.uint64(3) + e[:, s]
                keys.append((k, np.uint64(3 ** (bounds[g + 1] - bounds[g]))))
            for c, chosen in enumerate(choices):
                cell = np.full(len(fp), c, np.uint64)
                for g in chosen:
                    cell = cell * keys[g][1] + keys[g][0]
                yield pa.record_batch([pa.array(node), pa.array(fp), pa.array(cell.view(np.int64))], ["node", "fp", "cell"])

    return nodes.mapInArrow(run, "node long, fp long, cell long")


def _near(e1: np.ndarray, f1: np.ndarray, e2: np.ndarray, f2: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that pass the Manhattan bound and then the Hamming distance."""
    found_i, found_j = [], []
    for at in range(0, len(f1), 128):
        low = np.abs(e1[at : at + 128, None, :].view(np.int8) - e2[None, :, :].view(np.int8)).sum(2, dtype=np.int16) <= distance
        i, j = np.nonzero(low)
        ok = np.bitwise_count(f1[at + i] ^ f2[j]) <= distance
        found_i.append(i[ok] + at)
        found_j.append(j[ok])
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _links_of(node: np.ndarray, fp: np.ndarray, starts: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Spanning links of runs of equal cells."""
    us, vs = [], []
    ends = [*starts[1:].tolist(), len(fp)]
    emb = _embedding(fp)
    size = np.diff([*starts, len(fp)])
    starts = np.asarray(starts)
    two = starts[size == 2]
    if len(two):  # most cells: one pair, all at once
        low = np.abs(emb[two].view(np.int8) - emb[two + 1].view(np.int8)).sum(1, dtype=np.int16) <= distance
        two = two[low]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        us += node[two].tolist()
        vs += node[two + 1].tolist()
    for k in np.flatnonzero(size > 2):
        a, b = int(starts[k]), int(ends[k])
        i, j = _near(emb[a:b], fp[a:b], emb[a:b], fp[a:b], distance)
        i, j = i[i < j], j[i < j]
        for x, y in _forest(b - a, i, j):
            us.append(int(node[a + x]))
            vs.append(int(node[a + y]))
    return us, vs


def links(nodes: DataFrame, distance: int = 4, n: int | None = None) -> DataFrame:
    """u, v long: links whose components are those of all pairs of nodes (node long, fp long distinct) within
    `distance`."""
    n = nodes.count() if n is None else n
    cells = _cells(nodes, distance, groups_for(n, distance))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    cells = cells.join(dealt(sizes, n), "cell")
    k = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    # A cell of k blocks: its group (a, b) with a <= b holds the blocks a and b; of one block: the group (0, 0).
    blocks = cells.select(
        "cell", "node", "fp",
        F.when(k == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
            F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.struct(F.least(own, x).alias("a"), F.greatest(own, x).alias("b")))
        ).alias("g"),
    )
    blocks = blocks.select("cell", "node", "fp", F.explode("g").alias("g")).select("cell", "g.a", "g.b", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, rows
            if not held:
                return None
            c, a, b, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.flatnonzero((c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate([[0], new]).astype(np.int64)
            if last:
                stop, held, rows = len(c), [], 0
            else:  # the last run may go on in the next batch
                stop = int(starts[-1])
                held = [[x[stop:] for x in (c, a, b, node, fp)]]
                rows = len(c) - stop
                starts = starts[:-1]
            if not stop:
                return None
            us, vs = _links_of(node[:stop], fp[:stop].view(np.uint64), starts, distance)
            return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append([batch[x].to_numpy(zero_copy_only=False) for x in ("cell", "a", "b", "node", "fp")])
            rows += batch.num_rows
            if rows >= 100_000 and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return blocks.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(run, "u long, v long")


def labelled(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fp, label long (the smallest fingerprint of its component) of every distinct fingerprint of fps (fp long)."""
    nodes = cut(fps.select("fp").distinct())
    n = nodes.count()
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance, n))
    return nodes.join(dealt(found.withColumnRenamed("node", "fp"), n), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp long, component_id long of every row of docs (doc_id long, text string)."""
    fps = cut(fingerprints(docs, width))
    first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = first.count()
    labels = cut(labelled(first, distance).join(dealt(first, n), "fp"))
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    labels = labels.join(dealt(least, n), "label").select("fp", "component_id")
    return fps.join(dealt(labels, n), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The columns of docs for one row of each component: the one with the smallest doc_id (null last; of different
    texts with one doc_id the one with the smallest hash).  A group is only ever aggregated by min."""
    own = docs.withColumn("h__", F.xxhash64(text_or_empty()))
    fps = cut(fingerprints(own, width, "h__"))
    each = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h__")
    best = cut(fps.groupBy("fp").agg(F.min(each).alias("best")))
    best = labelled(best, distance).join(best, "fp").groupBy("label").agg(F.min("best").alias("best"))
    best = best.select(F.col("best.doc_id").alias("doc__"), F.col("best.h__").alias("hash__"))
    kept = own.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col("doc__")) & (F.col("h__") == F.col("hash__")), "left_semi")
    return kept.dropDuplicates(["doc_id", "h__"]).select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
