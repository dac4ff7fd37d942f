"""Benchmark decontamination by pigeonhole edit matching.

An item found in a text with at most k edits holds at least one of any k + 1
pieces of it unchanged. Items are cut into k + 1 pieces of near-equal length, an
Aho-Corasick automaton finds all exact piece hits in a text, and Myers'
bit-parallel distance verifies each window around a hit.

Texts are compared with A-Z in lower case and with ASCII punctuation and white
space as single spaces. The items travel to the executors in blocks of at most
BLOCK_CHARS characters; each block is one more pass over the rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bucket_of
from .kernels import slices

#: Edits allowed for each 100 characters of a normalised item.
EDITS_PER_100 = 7
BLOCK_CHARS = 4_000_000

_LUT = np.arange(256, dtype=np.uint8)
_LUT[65:91] += 32
_LUT[[ord(c) for c in string.punctuation + string.whitespace]] = 32


def normalised(buf: np.ndarray, off: np.ndarray) -> list[str]:
    """Each row of a slice in lower case (A-Z), with runs of punctuation and white space as one space, trimmed."""
    low = _LUT[buf]
    space = low == 32
    head = np.zeros(len(buf) + 1, bool)
    head[off] = True
    keep = ~space
    keep[1:] |= ~space[:-1] & ~head[1:-1]
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    raw = low[keep].tobytes()
    return [raw[a:b].decode("utf-8").rstrip(" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def normalise(text: str | None) -> str:
    column = pa.array([text or ""])
    return next(normalised(buf, off) for _, _, buf, off in slices(column))[0]


def budget(item: str) -> int:
    return len(item) * EDITS_PER_100 // 100


def pieces(item: str) -> list[tuple[int, str]]:
    """(start, piece) of the error budget plus one pieces of an item."""
    k = budget(item)
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(item: str, window: str, limit: int, peq: dict[str, int] | None = None) -> int:
    """Least edit distance of the item to any substring of the window, by Myers' bit vectors; stops at 0. At most limit + 1 is told apart."""
    peq = masks(item) if peq is None else peq
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return min(best, limit + 1)


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, s, budget(s), masks(s)) for i, s in items if s]
        by: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s, _, _) in enumerate(self.items):
            for start, piece in pieces(s):
                by.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by:
            self.automaton.make_automaton()
        self.empty = not by

    def find(self, text: str) -> dict[int, int]:
        """Item id -> edit distance of the best match within its budget. Every window around a hit is tried until one is exact."""
        if self.empty or not text:
            return {}
        spans: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, start in where:
                _, s, k, _ = self.items[n]
                a = end + 1 - size - start - k
                b = a + len(s) + 2 * k
                held = spans.setdefault(n, [])
                if held and a <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])
                else:
                    held.append([a, b])
        found: dict[int, int] = {}
        for n, held in spans.items():
            item_id, s, k, peq = self.items[n]
            best = k + 1
            if s in text:
                best = 0
            else:
                for a, b in held:
                    best = min(best, distance(s, text[max(a, 0) : b], k, peq))
                    if not best:
                        break
            if best <= k:
                found[item_id] = min(best, found.get(item_id, best))
        return found


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).dropna()
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        yield [(r["i"], normalise(r["t"])) for r in items.filter(bucket_of(F.col("i"), n) == k).collect()]


def _pass(docs: DataFrame, items: list[tuple[int, str]], text: str) -> DataFrame:
    """Extends the columns item_ids and distances by the block's matches."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            names = batch.schema.names
            ids, distances = batch.column("item_ids").to_pylist(), batch.column("distances").to_pylist()
            for a, _, buf, off in slices(batch.column(text)):
                for i, t in enumerate(normalised(buf, off), a):
                    for item, d in sorted(matcher.find(t).items()):
                        ids[i] = (ids[i] or []) + [item]
                        distances[i] = (distances[i] or []) + [d]
            cols = {c: batch.column(c) for c in names} | {"item_ids": pa.array(ids, pa.list_(pa.int64())), "distances": pa.array(distances, pa.list_(pa.int32()))}
            yield pa.record_batch(cols)

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds item_ids and distances (arrays, empty where nothing matches) to every row of docs; input columns of these names are replaced.

    Null and empty texts match nothing; null items, those with a null id and
    those without a letter or digit are not searched for. Items of one text are
    all reported; of repeated ids the best distance is. Repeated rows are each judged.
    """
    own = [c for c in docs.columns if c not in ("item_ids", "distances")]
    out = docs.select(*own, F.array().cast("array<bigint>").alias("item_ids"), F.array().cast("array<int>").alias("distances"))
    for items in _blocks(benchmark, item_id, item_text):
        out = _pass(out, items, text)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with all columns."""
    return find_leaks(docs, benchmark, text).filter(F.size("item_ids") == 0).select(docs.columns)


