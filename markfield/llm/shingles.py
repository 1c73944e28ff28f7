"""Near-duplicates by shingles of five words: documents link where the Jaccard similarity of their shingle sets is 0.8 or
more.  SimHash finds the nearest of them, an exact set-similarity join all that it misses.

Equal sets are one node.  A node's fingerprint is the SimHash of its shingles; candidates are nodes with one fingerprint and
those that operator 6's join (segment-popcount embedding, grid cells, Manhattan bound, exact distance) links at DISTANCE or
fewer differing bits.  They are verified on their whole sets, and what holds is joined before the next step.  Similar sets
can differ in more bits, so the result does not rest on the fingerprints.

Shingles have a global order, frequent ones last, and a node's prefix is its first n - ceil(0.8 n) + 1: two sets that reach the threshold share a token of their prefixes.  A pair that shares c prefix
tokens has at most c + max(ceil(0.8 n) - 1) tokens in common; pairs for which that suffices are verified on their whole
sets.  The frequencies come from a sample of the texts: any order gives the same result, it sets the work only.

Components are wanted, not pairs.  Each of ROUNDS rounds compares the nodes of a prefix token with one of them only; what
these links join needs no comparison any more, so a large group of near copies is not paired within itself.  The last
round compares all that is left.

Defined cases: words are those of operator 6; texts of fewer words than a shingle are one shingle; texts without words
(also null) are alike; rows with one doc_id and different texts link by their texts only; of a component the row with the
smallest doc_id stays (null last; then the smallest hash of the text).  Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfield.llm import simhash
from markfield.llm.components import components
from markfield.llm.shared import cut, settled, text_or_empty

WIDTH, ROUNDS, DISTANCE = 5, 2, 4
#: Bits of the filter that keeps texts that are not asked for out of a shuffle; a broadcast of BITS / 64 rows at most.
BITS = 1 << 23
#: Texts of the sample, at least and as a share; frequent shingles that are told apart.
SAMPLE, SHARE, FREQUENT = 10_000, 16, 200_000


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes (int64), ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    n = max(len(h) - width + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - 2**63


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of shingles as a signed integer: the bits that over half of them have."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(s), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(s[at : at + 65536].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(s), bitorder="little").view("<i8")[0])


def least_shared(n: int) -> int:
    """ceil(0.8 n)"""
    return -(-4 * n // 5)


def prefix(s: np.ndarray, hot: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the global order: by count, then by hash.  hot: ascending hashes that have a count."""
    at = np.searchsorted(hot, s)
    at[at == len(hot)] = 0
    c = np.where(hot[at] == s, count[at], 0) if len(hot) else np.zeros(len(s), np.int64)
    return s[np.argsort(c, kind="stable")[: len(s) - least_shared(len(s)) + 1]]


def _sets(own: DataFrame) -> DataFrame:
    """doc_id, h__, node, fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b["text"]]
            ids, fps = [set_id(s) for s in sets], [fingerprint(s) for s in sets]
            yield pa.record_batch([b["doc_id"], b["h__"], pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "h__", "node", "fp"])

    return own.mapInArrow(run, "doc_id long, h__ long, node long, fp long")


def _simhash_pairs(best: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: nodes with one fingerprint and nodes of linked fingerprints, the first of each fingerprint for all."""
    first = cut(best.groupBy("fp").agg(F.min("node").alias("lead")))
    alike = best.join(first, "fp").where("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    found = simhash.links(first.select(F.col("fp").alias("node"), "fp"), distance)
    a, b = (first.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "uv")
    return alike.unionByName(found.distinct().join(a, "u").join(b, "v").select(F.col("lead_u").alias("u"), F.col("lead_v").alias("v")))


def _likely(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of own whose h__ may be a hash__ of wanted: all that are, and others at the density of the filter."""
    place = lambda h: F.pmod(h, F.lit(BITS))
    at = wanted.select(place(F.col("hash__")).alias("p")).select(F.expr("p div 64").alias("word__"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    words = F.broadcast(at.groupBy("word__").agg(F.bit_or("bit").alias("bits__")))
    keyed = own.withColumn("p__", place(F.col("h__"))).withColumn("word__", F.expr("p__ div 64"))
    return keyed.join(words, "word__").where("bit_get(bits__, cast(p__ % 64 as int)) = 1").select(*own.columns)


def _frequent(own: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample and their counts; at most FREQUENT rows reach the driver."""
    step = max(1, min(SHARE, n // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b["text"]:
                yield pa.record_batch([pa.array(shingles(t.as_py()))], ["t"])

    each = own.where(F.pmod("h__", F.lit(step)) == 0).mapInArrow(run, "t long")
    rows = each.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "t").limit(FREQUENT).toArrow()
    t, c = (rows[x].to_numpy() for x in ("t", "c"))
    order = np.argsort(t)
    return t[order], c[order]


def _shared_tokens(own: DataFrame, hot: np.ndarray, count: np.ndarray) -> DataFrame:
    """t, node, n (size of the set) of the prefix tokens that several nodes have."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, nodes, sizes = [np.zeros(0, np.int64)], [], []
            for text in b["text"]:
                s = shingles(text.as_py())
                if len(s):
                    ts.append(prefix(s, hot, count))
                    nodes += [set_id(s)] * len(ts[-1])
                    sizes += [len(s)] * len(ts[-1])
            yield pa.record_batch([pa.array(np.concatenate(ts)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32())], ["t", "node", "n"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = [b[x].to_numpy(zero_copy_only=False) for x in ("t", "node", "n")]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            stop = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last run may go on
            held = [x[stop:] for x in rows]
            yield of([x[:stop] for x in rows])
        if held is not None:
            yield of(held)

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        t, node, n = rows
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])  # copies
        t, node, n = t[first], node[first], n[first]
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.record_batch([pa.array(x[keep]) for x in (t, node, n)], ["t", "node", "n"])

    schema = "t long, node long, n int"
    return own.select("text").mapInArrow(tokens, schema).repartition("t").sortWithinPartitions("t", "node").mapInArrow(several, schema)


def _enough(pairs: DataFrame) -> DataFrame:
    """u, v of the pairs (u, nu, v, nv; a row a shared token) whose shared prefix tokens let them reach the threshold."""
    sized = pairs.where("5 * least(nu, nv) >= 4 * greatest(nu, nv)")
    counted = sized.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("c"))
    return counted.where("c + (4 * greatest(nu, nv) + 4) div 5 - 1 >= (4 * (nu + nv) + 8) div 9").select("u", "v")


@settled()
def _verified(pairs: DataFrame, own: DataFrame, best: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have the similarity."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = nodes.join(best, "node").select("node", F.col("best.doc_id").alias("doc__"), F.col("best.h__").alias("hash__"))
    wanted = cut(wanted)
    texts = _likely(own, wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("doc__")) & (F.col("h__") == F.col("hash__"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingles(t.as_py()).tobytes() for t in b["text"]]
            yield pa.record_batch([b["node"], pa.array(s, pa.binary())], ["node", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b["su"], b["sv"], strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
                c = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(5 * c >= 4 * (len(x) + len(y) - c))
            yield pa.record_batch([b["u"], b["v"]], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    sets = cut(texts.mapInArrow(run, "node long, s binary").dropDuplicates(["node"]))
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "s": "su"}), "u").join(sets.withColumnsRenamed({"node": "v", "s": "sv"}), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(similar, "u long, v long")


@settled()
def _links(own: DataFrame, best: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """u, v long: links of nodes whose components are those of all similar pairs."""
    found = _verified(_simhash_pairs(best), own, best)
    rows = _open_tokens(own, found)
    for k in range(rounds + 1):
        a, b = (rows.select("t", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}")) for x in "uv")
        if k < rounds:
            lead = rows.groupBy("t").agg(F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("r"), "node", "n", "part")).alias("l"))
            a = lead.select("t", F.col("l.node").alias("u"), F.col("l.n").alias("nu"), F.col("l.part").alias("pu"))
            pairs = a.join(b, "t").where("pu != pv")
        else:
            pairs = a.join(b, "t").where("u < v and pu != pv")
        found = cut(found.unionByName(_verified(_enough(pairs), own, best)))
        if k < rounds:
            rows = _of_several(_parts(rows, found))
    return found


@settled()
def _open_tokens(own: DataFrame, found: DataFrame) -> DataFrame:
    """t, node, n, part of the shared tokens that several parts have."""
    return _of_several(_parts(cut(_shared_tokens(own, *_frequent(own, own.count()))), found))


def _parts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """t, node, n, part: the component of the node among the links found."""
    part = components(found).withColumnRenamed("component", "c__")
    return rows.join(part, "node", "left").select("t", "node", "n", F.coalesce("c__", "node").alias("part"))


@settled()
def _of_several(rows: DataFrame) -> DataFrame:
    """The rows of tokens that several parts have."""
    rows = cut(rows)
    most = rows.groupBy("t").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("t")
    return rows.join(most, "t", "left_semi")


def representatives(docs: DataFrame) -> DataFrame:
    """The columns of docs for one row of each component."""
    whole = docs.withColumn("h__", F.xxhash64(text_or_empty()))
    own = whole.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "h__")
    each = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h__")
    best = cut(_sets(own).groupBy("node").agg(F.min(each).alias("best"), F.min("fp").alias("fp")))
    labels = components(_links(own, best))
    least = best.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("label")).agg(F.min("best").alias("best"))
    least = least.select(F.col("best.doc_id").alias("doc__"), F.col("best.h__").alias("hash__"))
    kept = whole.join(least, F.col("doc_id").cast("long").eqNullSafe(F.col("doc__")) & (F.col("h__") == F.col("hash__")), "left_semi")
    return kept.dropDuplicates(["doc_id", "h__"]).select(*docs.columns)
