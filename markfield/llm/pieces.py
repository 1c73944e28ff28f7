"""Operator 3: SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

All pieces are in one automaton.  A text is read once, character by character; at each position the output links give
the pieces that end there, longest first, and each relaxes the best score of that position.  On equal scores the piece
that starts earliest wins.  A character without a piece of its own costs the least score less 10 and becomes byte
pieces.  No piece continues from another character into white space, so best paths of the runs "spaces, then other
characters" are independent: each distinct run is solved once and remembered (bounded by CACHE entries).

Decoding gives the text back exactly, also where it holds the white-space mark U+2581 itself (that becomes bytes).

Defined cases: null text is empty and has no tokens; repeated rows give a row each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.shared import importable, table, text_or_empty

MARK, UNKNOWN_PENALTY, CACHE = "▁", 10.0, 500_000
#: Longer runs are not remembered.
REMEMBER = 64
_RUN = re.compile(" *[^ ]+| +")


class PieceCodec:
    def __init__(self, path: str, cache: int = CACHE):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.known = cache, {}
        self.automaton, self.alone, self.byte_id, self.surface = ahocorasick.Automaton(), set(), {}, []
        least = 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                text, score = piece.replace(MARK, " "), sp.get_score(i)
                least = min(least, score)
                self.automaton.add_word(text, (len(text), score, i))
                self.surface.append(text.encode())
                if len(text) == 1:
                    self.alone.add(text)
        self.automaton.make_automaton()
        self.unknown = least - UNKNOWN_PENALTY

    def best(self, run: str) -> list[int]:
        """Ids of the best path through one run, by a single pass."""
        n, none = len(run), float("-inf")
        score, back = [none] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        ends: list[list | None] = [None] * (n + 1)
        for end, found in self.automaton.iter(run):
            if ends[end + 1] is None:
                ends[end + 1] = [found]
            else:
                ends[end + 1].append(found)
        for e in range(1, n + 1):
            top, how = none, None
            for size, s, i in ends[e] or ():  # longest first
                if (x := score[e - size] + s) > top:
                    top, how = x, (size, i)
            if run[e - 1] not in self.alone and (x := score[e - 1] + self.unknown) > top:
                top, how = x, (1, -1)
            score[e], back[e] = top, how
        out: list[int] = []
        e = n
        while e:
            size, i = back[e]
            if i < 0:
                out.extend(self.byte_id[b] for b in reversed(run[e - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
            e -= size
        out.reverse()
        return out

    def encode(self, text: str) -> array:
        if not text:
            return array("I")
        runs = _RUN.findall(" " + text)
        found = list(map(self.known.get, runs))
        if None in found:
            if len(self.known) + len(found) > 2 * self.most:
                self.known.clear()
            new = {r: array("I", self.best(r)).tobytes() for r in {r for r, f in zip(runs, found, strict=True) if f is None}}
            self.known.update((r, x) for r, x in new.items() if len(r) <= REMEMBER)
            found = [new[r] if f is None else f for r, f in zip(runs, found, strict=True)]
        return array("I", b"".join(found))

    def decode(self, ids: array) -> str:
        return b"".join(map(self.surface.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@cache
def codec(path: str) -> PieceCodec:
    """One a worker process, for all its tasks."""
    return PieceCodec(path)


def encode(docs: DataFrame, model_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 long, round_trip boolean (decoding gave the text back) and, if asked
    for, ids array<int>.  model_path must be readable on every executor."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        low, high = min(c.byte_id.values(), default=0), max(c.byte_id.values(), default=-1)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b["text"].to_pylist():
                ids = c.encode(text)
                x = np.frombuffer(ids, np.uint32)
                few = int(((x >= low) & (x <= high)).sum())
                for to, x in zip(out, (len(ids), few, zlib.crc32(ids.tobytes()), c.decode(ids) == text, list(ids) if keep_ids else None), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)][: 5 if keep_ids else 4]
            yield pa.record_batch([b["doc_id"], *arrays], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "ids"][: 1 + len(arrays)])

    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids array<int>); null ids give null."""
    importable(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b["ids"].to_pylist()]
            yield pa.record_batch([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, name: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(name), keep_ids=False)
