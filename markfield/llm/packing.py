"""Operator 9: best-fit packing by bin completion.

Documents become token ids (the tokenizer file is a parameter) and end with the id 0; only documents longer than a
sequence are cut.  Whether a set of pieces can be packed into few sequences depends on the counts of their lengths
alone, and there are at most `capacity` lengths: the plan is made on that histogram, whose size does not grow with the
corpus, and then pieces are dealt to the plan's slots by their rank within their length, without gathering them.

The plan is bin completion.  Whole packings are the first incumbents, until one reaches the lower bound: best-fit
decreasing, and greedy ones that take a least-waste filling around the largest length left as often as the counts allow.
Of least-waste fillings the first greedy packing takes the one whose smallest piece is largest, so that short pieces are
there to fill up the last sequences; it finds it exactly, from the sums that can be reached, kept as bits.  The second
takes long pieces first.  Where none reaches the bound, branch and bound goes on over whole packings: a state is the
counts that are left; its branches are the undominated fillings of the sequence with the largest length, once or as often
as the counts allow; a state is completed by best-fit decreasing, and dropped if its waste and the bound of the rest
cannot beat the incumbent.  Multiplicities make the work depend on the lengths, not on the corpus.

The problem is NP-hard: NODES bounds the search for a filling (not that by sums) and STATES the states of the whole
search.  Within them the packing is optimal; beyond them it is the best found, and never worse than best-fit decreasing.

Defined cases: null text is empty and is one token, the id 0; repeated rows are packed each; a null doc_id is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import threading
import time
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, partial
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markfield.llm.shared import cut, give_back, table, text_or_empty

CAPACITY, NODES, STATES = 2048, 2000, 500
#: Roundings of the lengths that the lower bound tries.
ROUNDED = 100
#: Pieces of a part of a length, and parts beyond one a length.
SHARE, PARTS = 1 << 18, 1 << 16
#: Entries of a worker's cache of words; beyond it the cache starts anew.  Longer chunks are not remembered.
CACHE, REMEMBER, IDLE = 500_000, 64, 4.0
#: Characters that Python takes for white space and the tokenizer may not, or that may be white space to it alone, and
#: the beginning of special tokens: such texts go to the tokenizer whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]|<\\|")


#: A chunk that is one run of Latin letters (without the one whose lower case is two characters) and at most one mark.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]?)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 onwards."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of whole texts, as little-endian uint32 bytes, equal to the tokenizer's on the whole text.

    The tokenizer drops white space and no token crosses it, so ids of white-space separated chunks can be computed
    once each and looked up afterwards.  A chunk that is a plain word goes to the tokenizer's model without the
    pipeline around it, all others go through all of it."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), cache
        self.used = time.monotonic()
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.model, self.letters = self.tok.model, byte_letters()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.most:
                self.words.clear()
            spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(word) <= REMEMBER:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if m := _PLAIN.fullmatch(chunk):
            word, mark = m.groups()
            return self._word(word.lower()) + (self._mark(mark) if mark else b"")
        return array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _mark(self, mark: str) -> bytes:
        found = self.words.get(mark)
        if found is None:
            found = self.words[mark] = array("I", self.tok.encode(mark, add_special_tokens=False).ids).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        self.used = time.monotonic()
        if _ODD.search(text):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.split()
        found = list(map(self.cache.get, chunks))
        if None in found:
            if len(self.cache) + len(found) > 2 * self.most:
                self.cache.clear()
            new = {c: self._chunk(c) for c in {c for c, f in zip(chunks, found, strict=True) if f is None}}
            self.cache.update((c, x) for c, x in new.items() if len(c) <= REMEMBER)
            found = [new[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)


@cache
def _tokenizer(path: str) -> WordTokenizer:
    """One a worker process, for all its tasks; what it remembers goes when no text has come for IDLE seconds."""
    tok = WordTokenizer(path)

    def forget() -> None:
        while True:
            time.sleep(IDLE / 2)
            if tok.cache and time.monotonic() - tok.used > IDLE:
                tok.cache.clear()
                tok.words.clear()
                give_back()

    threading.Thread(target=forget, daemon=True).start()
    return tok


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long and, if asked for, ids binary (little-endian uint32).
    tokenizer_path must be readable on every executor (part of the Python environment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(tokenizer_path)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = tok.encode(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for to, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = 6 if keep_ids else 5
            yield pa.record_batch([pa.array(x, t) for x, t in list(zip(out, kinds, strict=True))[:n]], list(names[:n]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def completion(lengths: list[int], counts: list[int], room: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """The filling of `room` with least waste: (index, times) over lengths (descending) of which counts are there.
    Branch and bound, best fit first."""
    best: list[tuple[int, int]] = []
    best_waste, visited = room + 1, 0
    smallest = next((x for x, c in zip(reversed(lengths), reversed(counts), strict=True) if c), room + 1)
    below = [0] * (len(lengths) + 1)  # all that is left from an index on, for the waste bound
    for i in range(len(lengths) - 1, -1, -1):
        below[i] = min(room, below[i + 1] + lengths[i] * counts[i])
    chosen: list[tuple[int, int]] = []
    reached: dict[int, int] = {}  # room -> least index from which fillings of that room were enumerated

    def visit(i: int, left: int) -> None:
        nonlocal best, best_waste, visited
        # Lengths from i on are untouched, so what can follow depends on (i, left) alone: a partial filling whose room a
        # filling with larger lengths reached before, from no later an index, is dominated by it.
        if reached.get(left, len(lengths) + 1) <= i:
            return
        reached[left] = i
        visited += 1
        if left < best_waste:
            best, best_waste = chosen.copy(), left
        while best_waste and visited < nodes and left >= smallest:
            # the next length that fits, by bisection in the descending list
            lo, hi = i, len(lengths)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if lengths[mid] > left else (lo, mid)
            while lo < len(lengths) and not counts[lo]:
                lo += 1
            if lo == len(lengths) or left - below[lo] >= best_waste:  # all that is left cannot fall below the incumbent
                return
            i = lo + 1
            for times in range(min(counts[lo], left // lengths[lo]), 0, -1):
                chosen.append((lo, times))
                visit(lo + 1, left - times * lengths[lo])
                chosen.pop()
                if not best_waste or visited >= nodes:
                    return

    visit(0, room)
    return best


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """As completion, without a bound on the search: a filling of `room` with least waste, and of those one whose smallest
    piece is largest.  The sums that the lengths so far can reach are the bits of a number, and the first length with which
    the best sum is reached is in the filling; so it goes on with the rest of the sum among the lengths before."""
    reached, steps = 1, []  # steps: index, times, sums reached before it
    for i, (x, c) in enumerate(zip(lengths, counts, strict=True)):
        most, times = min(c, room // x), 1
        while most:  # 1, 2, 4 ... and the rest make up every number of times
            times = min(times, most)
            steps.append((i, times, reached))
            reached |= reached << times * x & (2 << room) - 1
            most, times = most - times, 2 * times
        if reached >> room:
            break
    total, used = reached.bit_length() - 1, {}
    for i, times, before in reversed(steps):
        if not before >> total & 1:
            used[i] = used.get(i, 0) + times
            total -= times * lengths[i]
    return list(used.items())


Patterns = list[tuple[int, list[tuple[int, int]]]]
Fill = Callable[[list[int], list[int], int], list[tuple[int, int]]]


def greedy(lengths: list[int], counts: list[int], capacity: int, fill: Fill = completion) -> Patterns:
    """The least-waste filling around the largest length left, as often as the counts allow, until nothing is left."""
    out: Patterns = []
    while left := [(x, c) for x, c in zip(lengths, counts, strict=True) if c]:
        lengths, counts = [x for x, _ in left], [c for _, c in left]
        while all(counts):
            used = {0: 1}
            for i, times in fill(lengths, [counts[0] - 1, *counts[1:]], capacity - lengths[0]):
                used[i] = used.get(i, 0) + times
            often = min(counts[i] // times for i, times in used.items())
            for i, times in used.items():
                counts[i] -= often * times
            out.append((often, [(lengths[i], times) for i, times in used.items()]))
    return out


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> Patterns:
    """Best-fit decreasing, on classes of equal sequences: as often as it fits, a length goes into those with least room."""
    open_: list[tuple[int, int, list[tuple[int, int]]]] = []  # room, sequences, items; by room
    full: Patterns = []

    def put(room: int, n: int, items: list[tuple[int, int]]) -> None:
        open_.insert(bisect_right(open_, (room, inf)), (room, n, items))

    for length, c in zip(lengths, counts, strict=True):
        while c:
            k = bisect_left(open_, (length,))
            room, n, items = open_.pop(k) if k < len(open_) else (capacity, c, [])
            each = min(room // length, c)
            take = min(n, c // each)
            c -= take * each
            if take < n and items:
                put(room, n - take, items)
            if room - each * length:
                put(room - each * length, take, [*items, (length, each)])
            else:
                full.append((take, [*items, (length, each)]))
    return full + [(n, items) for _, n, items in open_]


@lru_cache(4)
def _rounded(lengths: tuple[int, ...], capacity: int) -> np.ndarray:
    """A row for each k up to ROUNDED: lengths in units of 1 / k of a sequence's, rounded down in (k + 1)-ths of capacity
    where those are no whole number, so that what fits in a sequence sums up to k units at most (times capacity)."""
    x, k = np.array(lengths, np.int64), np.arange(1, ROUNDED + 1)[:, None]
    return np.where((k + 1) * x % capacity, (k + 1) * x // capacity * capacity, k * x)


def sequences_needed(lengths: list[int], counts: list[int], capacity: int) -> int:
    """Lower bound: the volume; for every length s up to half a sequence, pieces over capacity - s have a sequence each,
    those over half one that only their own room can fill up with pieces of s and more; and the volume of lengths rounded
    so that no sequence holds more than one."""
    best = -(-sum(x * c for x, c in zip(lengths, counts, strict=True)) // capacity)
    left = [(x, c) for x, c in zip(lengths, counts, strict=True) if c]
    n, v = [0], [0]
    for x, c in left:
        n.append(n[-1] + c)
        v.append(v[-1] + x * c)
    lone = half = sum(2 * x > capacity for x, _ in left)
    for i, (s, _) in enumerate([*left[half:], (0, 0)]):
        while lone and left[lone - 1][0] <= capacity - s:  # lone: longer than capacity - s
            lone -= 1
        free = (n[half] - n[lone]) * capacity - (v[half] - v[lone])
        small = v[half + i + 1] - v[half] if s else v[-1] - v[half]
        best = max(best, n[half] + max(0, -(-(small - free) // capacity)))
    units = _rounded(tuple(lengths), capacity) @ np.array(counts, np.int64)
    return max(best, *(-(-u // (k * capacity)) for k, u in enumerate(units.tolist(), 1)))


def fillings(lengths: list[int], counts: list[int], capacity: int, nodes: int = NODES) -> list[tuple[int, dict[int, int]]]:
    """(waste, {index: times}) of the undominated fillings of the sequence with the largest length left, least waste first
    (of the first `nodes` partial ones).  Dominated: another piece still fits, or a longer one fits in place of one."""
    at = next(i for i, c in enumerate(counts) if c)
    live = [i for i in range(at, len(lengths)) if counts[i]]
    place = {i: k for k, i in enumerate(live)}
    falling = [-lengths[i] for i in live]
    out: list[tuple[int, dict[int, int]]] = []
    stack: list[tuple[int, int, dict[int, int]]] = [(0, capacity - lengths[at], {at: 1})]
    visited = 0

    def spare(k: int, step: int, used: dict[int, int]) -> int:
        """The length of the first piece that is not used from place k on; 0 if there is none."""
        while 0 <= k < len(live) and used.get(live[k], 0) >= counts[live[k]]:
            k += step
        return lengths[live[k]] if 0 <= k < len(live) else 0

    while stack and visited < nodes:
        k, room, used = stack.pop()
        visited += 1
        k = bisect_left(falling, -room, k)
        while k < len(live) and used.get(live[k], 0) >= counts[live[k]]:
            k += 1
        if k < len(live):
            i = live[k]
            most = min(room // lengths[i], counts[i] - used.get(i, 0))
            stack += [(k + 1, room - t * lengths[i], used | {i: used.get(i, 0) + t} if t else used) for t in range(most + 1)]
            continue
        if 0 < spare(len(live) - 1, -1, used) <= room:
            continue
        own = used if used[at] > 1 else [i for i in used if i != at]  # the first piece is given
        if not room or not any(0 < spare(place[i] - 1, -1, used) <= lengths[i] + room for i in own):
            out.append((room, used))
    out.sort(key=lambda x: x[0])
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, states: int = STATES) -> Patterns:
    """Patterns (times used, [(length, times in a sequence)]) that use up the histogram of lengths."""
    lengths = sorted((x for x, c in histogram.items() if c), reverse=True)
    counts = [histogram[x] for x in lengths]
    size = lambda p: sum(often for often, _ in p)
    best, bound = best_fit(lengths, counts, capacity), sequences_needed(lengths, counts, capacity)
    for fill in (fullest, partial(completion, nodes=nodes)):
        if size(best) > bound:
            best = min(best, greedy(lengths, counts, capacity, fill), key=size)
    seen: dict[tuple[int, ...], int] = {}
    # Sequences so far, their patterns as a chain to the parents, counts left, and a filling still to be applied.
    stack: list[tuple[int, tuple, list[int], dict[int, int], int]] = [(0, (), counts, {}, 0)]
    while stack and size(best) > bound and len(seen) < states:
        done, chain, left, used, often = stack.pop()
        if used:
            left = left.copy()
            for i, times in used.items():
                left[i] -= often * times
            done, chain = done + often, (chain, (often, [(lengths[i], t) for i, t in used.items()]))
        if done + sequences_needed(lengths, left, capacity) >= size(best) or seen.get(tuple(left), done + 1) <= done:
            continue
        seen[tuple(left)] = done
        rest = best_fit(lengths, left, capacity)
        if done + size(rest) < size(best):
            best, link = rest, chain
            while link:
                best = [link[1], *best]
                link = link[0]
        for _, used in reversed(fillings(lengths, left, capacity, nodes) if any(left) else []):
            most = min(left[i] // t for i, t in used.items())
            stack += [(done, chain, left, used, n) for n in sorted({1, most})]
    return best


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, sequences, offset) of every run of slots: rank r of the length
    is in sequence first + (r - first rank) % sequences, at offset + length * ((r - first rank) // sequences)."""
    out, base, given = [], 0, {}
    for often, items in patterns:
        offset = 0
        for length, times in items:
            r = given.get(length, 0)
            out.append((length, r, r + often * times - 1, base, often, offset))
            given[length] = r + often * times
            offset += length * times
        base += often
    return out


def _clipped(runs: list[tuple], counts: dict[int, list[tuple[int, int]]]) -> list[tuple]:
    """Runs of slots as the parts of a length see them: (length, part, first of the part's ranks that is in the run, counted
    in the part; rank of the part's first piece; lo, seq, times, off of the run).  counts: parts with their pieces."""
    out, of = [], {}
    for run in runs:
        of.setdefault(run[0], []).append(run)  # by rank
    for length, parts in counts.items():
        first, at = 0, 0
        for part, n in parts:
            while of[length][at][2] < first:
                at += 1
            k = at
            while k < len(of[length]) and of[length][k][1] < first + n:
                _, lo, _, seq, times, off = of[length][k]
                out.append((length, part, max(lo, first) - first, first, lo, seq, times, off))
                k += 1
            first += n
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, share: int = SHARE) -> DataFrame:
    """Adds sequence_id long and offset long to rows of (doc_id, piece, length, ids_crc32, ...).

    A length's pieces are dealt to parts of about `share` pieces by hash, so a hot length is many tasks' work, and ranked in
    their part; a part's runs of slots stand among its pieces at the ranks where they begin, and a piece takes the last run
    before it.  The driver sees counts of lengths and parts: capacity and at most PARTS more."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    share = max(share, sum(histogram.values()) // PARTS + 1)
    own = spark.createDataFrame([(x, -(-n // share)) for x, n in histogram.items()], "length long, parts long")
    keyed = cut_pieces.join(F.broadcast(own), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in keyed.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").collect():
        counts.setdefault(r["length"], []).append((r["part"], r["n"]))
    names = ("length", "part", "at", "first", "lo", "seq", "times", "off")
    told = list(zip(*_clipped(slots(plan(histogram, capacity, nodes)), counts), strict=True)) or [[]] * len(names)
    runs = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in told], names=list(names)))
    piece = F.struct(*[F.col(c) for c in cut_pieces.columns]).alias("p")
    run_ = F.struct("at", "first", "lo", "seq", "times", "off").alias("run")
    both = keyed.select("length", "part", F.lit(1).alias("kind"), piece).unionByName(runs.select("length", "part", F.lit(0).alias("kind"), run_), allowMissingColumns=True)
    by = Window.partitionBy("length", "part")
    ranked = by.orderBy("kind", "p.doc_id", "p.piece", "p.ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("r", F.when(F.col("kind") == 1, F.sum("kind").over(ranked) - 1).otherwise(F.col("run.at")))
    upto = by.orderBy("r", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("s", F.last("run", ignorenulls=True).over(upto)).where("kind = 1").withColumn("g", F.col("r") + F.col("s.first") - F.col("s.lo"))
    return placed.select("p.*", F.expr("s.seq + g % s.times").alias("sequence_id"), F.expr("s.off + length * (g div s.times)").alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return pack(cut(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(name))))
