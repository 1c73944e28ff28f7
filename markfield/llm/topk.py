"""Operator 8: exact top-k by inner product on a bit-sliced index.

Components are quantised to whole numbers.  The index holds blocks of at most BLOCK vectors: for every dimension the
value less the block's least value, as bit slices (slice j of a dimension is a bitmap of the block's rows).  For a
query the score's slices are added by bitmap arithmetic: each set bit b of |q_d| adds the dimension's slices with weight
b (complemented where q_d is negative, which shifts all scores of the query alike), three bitmaps of a weight becoming
a sum and a carry.  The k best rows of the block are then found from the most significant score slice downward; rows
that tie at the boundary are resolved exactly by vec_id.  Blocks give k rows each, the k best of those are the answer.

Rows are dealt to blocks by direction (the nearest of at most CENTRES vectors of a sample; this sets the work, not the
result), and a block has the least and greatest value of every dimension, which bound the score of any of its rows.  A
first round searches, for every block of queries, the index block with the greatest bounds; its k-th scores are
thresholds, and the second round leaves out queries that a block's bound keeps below theirs.  Where vectors have no
directions in common no bound helps, and every query block meets every index block: the work then grows with the
product of both.  Nothing is broadcast, no vector pair becomes a row, a task's memory is a block of each.

Defined cases: vectors that are null or hold null or non-finite components, or have a null vec_id, take no part; the
inner product is that of vectors of one length, so a query's candidates are the vectors of its own length (the empty
vector has score 0 with others); a query's own row is every row with its vec_id; repeated rows are candidates each; ties
go to the smaller vec_id; components of any size are added without overflow, and a score that no long holds is given
as the nearest long while the exact one decides the order; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markfield.llm.shared import cut, importable, table

BLOCK, QUERIES, CENTRES = 32768, 512, 64
#: Index blocks whose ends are one row, and tasks over which query blocks meet them.
CHUNK, SALTS = 256, 64
LONG = 2**63 - 1
#: Greatest magnitude of a component that is added in 64 bits (the width of a vector is below 2**20).
NARROW = 2**20


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<double> of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    return read.where(F.coalesce(ok, F.lit(False)))


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers: int64, or Python's where a value needs more."""
    if not x.size or np.abs(x).max() * scale < NARROW:
        return np.floor(x * scale).astype(np.int64)
    whole = [math.floor(Fraction(float(e)) * Fraction(scale)) for e in x.ravel()]
    return np.array(whole, dtype=object).reshape(x.shape)


def _planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value of every dimension, and bitmaps (dimension, bit, words) of the values above it."""
    low = x.min(0)
    up = x - low
    bits = int(up.max()).bit_length() if up.size else 0
    words = -(-len(x) // 64)
    planes = np.zeros((x.shape[1], bits, words * 64), np.uint8)
    for j in range(bits):
        planes[:, j, : len(x)] = ((up >> j) & 1).astype(np.uint8).T
    return low, np.packbits(planes, axis=2, bitorder="little").view("<u8") if bits else np.zeros((x.shape[1], 0, words), np.uint64)


def _packed(vectors: DataFrame, rows: int, scale: float, index: bool) -> DataFrame:
    """width int, low binary, high binary (of the values, pickled), block binary: at most `rows` vectors of one width of
    a partition, in order of vec_id, as index slices or as plain arrays of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            for width, parts in held.items():
                ids, x = (np.concatenate(a) for a in zip(*parts, strict=True))
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], quantised(x[order], scale)
                body = (ids, *_planes(v)) if index else (ids, v)
                out = [[width], [pickle.dumps(v.min(0), 5)], [pickle.dumps(v.max(0), 5)], [pickle.dumps(body, 5)]]
                yield pa.record_batch([pa.array(a, t) for a, t in zip(out, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["width", "low", "high", "block"])

        for b in batches:
            size = np.diff(b["x"].offsets.to_numpy())
            flat = np.array(b["x"].flatten(), np.float64)
            begin = np.concatenate([[0], np.cumsum(size)])
            ids = b["vec_id"].to_numpy(zero_copy_only=False)
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                for at in range(0, len(own), rows):
                    part = own[at : at + rows]
                    if n + len(part) > rows:
                        yield from blocks()
                        held, n = {}, 0
                    held.setdefault(int(width), []).append((ids[part], flat[begin[part][:, None] + np.arange(width)]))
                    n += len(part)
        yield from blocks()

    return vectors.mapInArrow(run, "width int, low binary, high binary, block binary")


def score_slices(q: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (bit, words) of the scores of one query, least significant first, and what is to be added to them for
    complemented slices."""
    dims, bits, words = planes.shape
    size = [abs(int(x)) for x in q]
    flip = np.array([x < 0 for x in q], bool)
    shift = -sum(s * ((1 << bits) - 1) for s, f in zip(size, flip, strict=True) if f)
    at: dict[int, list[int]] = {}  # weight -> places in planes, flattened
    for d, s in enumerate(size):
        for b in range(s.bit_length()):
            if s >> b & 1:
                for j in range(bits):
                    at.setdefault(b + j, []).append(d * bits + j)
    flat, full = planes.reshape(dims * bits, words), np.uint64(2**64 - 1)
    carries: dict[int, list[np.ndarray]] = {}
    out: list[np.ndarray] = []
    weight = 0
    while weight <= max([*at, *carries], default=-1):
        here = np.array(at.get(weight, ()), np.int64)
        own = flat[here]
        own[flip[here // max(bits, 1)]] ^= full
        rows = np.concatenate([own, *carries.pop(weight, ())])
        given = []
        while len(rows) > 2:  # carry-save: three bitmaps of a weight become a sum and a carry, all at once
            k = len(rows) // 3
            x, y, z = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            t = x ^ y
            given.append((x & y) | (t & z))
            t ^= z
            rows = np.concatenate([t, rows[3 * k :]])
        if len(rows) == 2:
            given.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
        if given:
            carries[weight + 1] = given
        out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        weight += 1
    return np.array(out, np.uint64).reshape(len(out), words), shift


def best_rows(slices: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely among the k best, and of rows that tie at the boundary."""
    sure, tie = np.zeros_like(valid), valid.copy()
    for s in slices[::-1]:
        high = tie & s
        new = sure | high
        n = int(np.bitwise_count(new).sum(dtype=np.int64))
        if n > k:
            tie = high
        else:
            sure = new
            if n == k:
                return sure, np.zeros_like(tie)
            tie = tie & ~s
    return sure, tie


def search(index: tuple, qid: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(vec_id, exact score) of the k best rows of a block, ties to the smaller vec_id."""
    ids, low, planes = index
    slices, shift = score_slices(q, planes)
    shift += sum(int(a) * int(b) for a, b in zip(q, low, strict=True))
    valid = np.zeros(planes.shape[2] * 64, np.uint8)
    valid[: len(ids)] = ids != qid
    sure, tie = best_rows(slices, np.packbits(valid, bitorder="little").view("<u8"), k)
    places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    rows = places(sure)
    rows = np.concatenate([rows, places(tie)[: k - len(rows)]])  # rows are in order of vec_id
    bit = (slices[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
    if len(slices) < 62:
        score = (bit.astype(np.int64) << np.arange(len(slices), dtype=np.int64)[:, None]).sum(0).tolist()
    else:
        score = [sum(1 << i for i in np.flatnonzero(bit[:, c]).tolist()) for c in range(len(rows))]
    return [(i, s + shift) for i, s in zip(ids[rows].tolist(), score, strict=True)]


def _beyond(score: int) -> bytes | None:
    """An exact score at or beyond the ends of a long, as bytes in the order of scores (components are below 2**1031)."""
    return (score + (1 << 2176)).to_bytes(274, "big") if abs(score) >= LONG else None


FOUND = "query_id long, vec_id long, score long, beyond binary"


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    q, v, s = ([r[c] for r in rows] for c in range(3))
    fit = [max(-LONG - 1, min(LONG, x)) for x in s]
    return pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(fit, pa.int64()), pa.array([_beyond(x) for x in s], pa.binary())], ["query_id", "vec_id", "score", "beyond"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest score that a row between low and high can have with each query (rows of q)."""
    return np.maximum(q, 0) @ high + np.minimum(q, 0) @ low


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows of each pair's index block for those of its queries that are wanted (null: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q, w in zip(b["block"], b["q"], b["wanted"], strict=True):
                index, (qids, x) = pickle.loads(i.as_py()), pickle.loads(q.as_py())
                rows = w.as_py() if w.is_valid else range(len(qids))
                yield _found([(int(qids[r]), v, s) for r in rows for v, s in search(index, int(qids[r]), x[r], k)])

    return pairs.select("block", "q", "wanted").mapInArrow(run, FOUND)


def _by_direction(vectors: DataFrame, blocks: int) -> DataFrame:
    """vectors dealt to about `blocks` partitions, rows of one direction together.  The centres are a sample of at most
    CENTRES vectors, taken by hash; they set the work only."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "x")).limit(CENTRES).select("x").collect()
    centres: dict[int, list[list[float]]] = {}
    for r in sample:
        centres.setdefault(len(r["x"]), []).append(r["x"])
    known = {w: np.array(c, np.float64).reshape(len(c), w) for w, c in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b["x"].offsets.to_numpy())
            flat, begin = np.array(b["x"].flatten(), np.float64), np.concatenate([[0], np.cumsum(size)])
            place = np.zeros(len(size), np.int32)
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                if width and int(width) in known:
                    with np.errstate(over="ignore", invalid="ignore"):
                        place[own] = np.argmax(np.nan_to_num(flat[begin[own][:, None] + np.arange(width)] @ known[int(width)].T), axis=1)
            yield pa.record_batch([b["vec_id"], b["x"], pa.array(size, pa.int32()), pa.array(place)], ["vec_id", "x", "w", "c"])

    placed = vectors.mapInArrow(run, "vec_id long, x array<double>, w int, c int")
    return placed.repartitionByRange(blocks, "w", "c", F.xxhash64("vec_id")).select("vec_id", "x")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = BLOCK, many: int = QUERIES) -> DataFrame:
    """query_id, rank int, vec_id, score long; vectors and queries: (vec_id long, x array<double>), see finite."""
    spark = vectors.sparkSession
    importable(spark)
    vectors, queries = cut(vectors), cut(queries)
    n, asking = vectors.count(), queries.count()
    index = cut(_packed(_by_direction(vectors, -(-n // block) or 1), block, scale, True).withColumn("i", F.monotonically_increasing_id()))
    asked = cut(_packed(queries.repartition(-(-asking // many) or 1), many, scale, False).withColumn("n", F.monotonically_increasing_id()))
    asks = asked.select("n", "width", F.col("block").alias("q"))
    # Query blocks meet the ends of index blocks, CHUNK of them a row, and are spread over tasks.
    salts = max(1, min(SALTS, asked.count()))
    ends = index.select("width", F.pmod(F.xxhash64("i"), F.lit(-(-index.count() // CHUNK) or 1)).alias("c"), F.struct("i", "low", "high").alias("e"))
    ends = ends.groupBy("width", "c").agg(F.collect_list("e").alias("ends")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = asks.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(salts)).cast("int")).join(ends, ["width", "salt"]).select("n", "q", "ends")

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, float]] = []
            for n, q, ends in zip(b["n"].to_pylist(), b["q"], b["ends"], strict=True):
                x = pickle.loads(q.as_py())[1]
                for e in ends.as_py():
                    most = bounds(x, pickle.loads(e["low"]), pickle.loads(e["high"]))
                    out.append((n, e["i"], float(max(-(10**300), min(10**300, sum(int(m) for m in most))))))
            yield pa.record_batch([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["n", "i", "top"])

    seeds = cut(met.mapInArrow(greatest, "n long, i long, top double").groupBy("n").agg(F.max_by("i", "top").alias("i")))
    tasks = max(1, min(4096, asked.count() * index.count()))
    whole = lambda p: p.join(asks.drop("width"), "n").join(index.select("i", "block"), "i").repartition(tasks)
    first = cut(_searched(whole(seeds.withColumn("wanted", F.lit(None).cast("array<int>"))), k))
    reached = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min(F.struct("score", "beyond")).alias("least")).where(F.col("c") >= k)
    # A query block's thresholds: at most `many` rows to a block.
    owners = asks.mapInArrow(_members, "n long, query_id long").join(reached, "query_id").where("least.beyond is null")
    least = owners.groupBy("n").agg(F.collect_list(F.struct("query_id", F.col("least.score").alias("score"))).alias("least"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, blocks, rows = [], [], []
            for n, seed, q, ends, least in zip(*(b[c].to_pylist() for c in ("n", "seed", "q", "ends", "least")), strict=True):
                qids, x = pickle.loads(q)
                bar = {r["query_id"]: r["score"] for r in least or ()}
                for e in ends:
                    most = bounds(x, pickle.loads(e["low"]), pickle.loads(e["high"]))
                    own = [r for r, i in enumerate(qids.tolist()) if i not in bar or int(most[r]) >= bar[i]]
                    if own and e["i"] != seed:
                        ns.append(n), blocks.append(e["i"]), rows.append(own)
            yield pa.record_batch([pa.array(ns, pa.int64()), pa.array(blocks, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["n", "i", "wanted"])

    rest = met.join(seeds.withColumnRenamed("i", "seed"), "n").join(least, "n", "left")
    pairs = cut(rest.mapInArrow(wanted, "n long, i long, wanted array<int>"))
    found = first.unionByName(_searched(whole(pairs), k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, q in zip(b["n"].to_pylist(), b["q"], strict=True):
            ids = pickle.loads(q.as_py())[0]
            yield pa.record_batch([pa.array([n] * len(ids), pa.int64()), pa.array(ids, pa.int64())], ["n", "query_id"])


def op8_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP8_SQL = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
"""
