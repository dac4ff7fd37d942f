"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Lengths are integers from 1 to the capacity, so the corpus is one histogram of
at most ``capacity`` counts. Best-fit decreasing treats equal lengths alike and
equal remaining capacities alike; the plan therefore places whole runs: all
bins with the same remaining capacity form a class, and a segment tree over the
capacities finds the tightest class that is not empty in logarithmic time. The
plan has a few runs per length whatever the size of the corpus, and pieces find
their place in it by their length and their rank among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import bucket_of, table
from .kernels import slices, span_hashes, words

CAPACITY = 2048
#: Pieces of one length are ranked within salts of about this many.
RANK_GROUP = 4_000
#: Salts whose counts one task sums.
SALT_BLOCK = 4_096
#: A worker's memo of chunk -> token ids is emptied at this many ids.
MEMO_IDS = 6_000_000
WHITE = " \t\n\v\f\r"


class TightestClass:
    """Segment tree over remaining capacities 0..n: which are in use, and the least one from a given one up."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.used = [False] * (2 * self.base)

    def set(self, at: int, on: bool) -> None:
        i = at + self.base
        self.used[i] = on
        while i > 1:
            i >>= 1
            on = self.used[2 * i] or self.used[2 * i + 1]
            if self.used[i] == on:
                break
            self.used[i] = on

    def least_from(self, at: int) -> int | None:
        i = at + self.base
        if self.used[i]:
            return at
        while i > 1:
            if not i & 1 and self.used[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Items first..first+count-1 (by rank) of a length: item j is in bin `bin + (j - first) // each`, at `offset + length * ((j - first) % each)`."""

    length: int
    first: int
    count: int
    bin: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over the histogram length -> count; the runs, and the number of bins."""
    tree, classes = TightestClass(capacity), {}  # remaining capacity -> stack of (first bin, bins)
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        classes.setdefault(room, []).append((first, n))
        tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            room = tree.least_from(length)
            if room is None:
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    runs.append(Run(length, rank, full * each, bins, each, 0))
                    put(capacity - each * length, bins, full)
                if rest:
                    runs.append(Run(length, rank + full * each, rest, bins + full, each, 0))
                    put(capacity - rest * length, bins + full, 1)
                bins += full + (rest > 0)
                break
            # the tightest bin takes as many of this length as fit before another becomes the tightest
            first, n = classes[room].pop()
            each = room // length
            m = min(n, todo // each)
            if m:
                runs.append(Run(length, rank, m * each, first, each, capacity - room))
                put(room - each * length, first, m)
                rank, todo, first, n = rank + m * each, todo - m * each, first + m, n - m
            elif todo:
                runs.append(Run(length, rank, todo, first, each, capacity - room))
                put(room - todo * length, first, 1)
                todo, first, n = 0, first + 1, n - 1
            if n:
                classes[room].append((first, n))
            if not classes[room]:
                tree.set(room, False)
    return runs, bins


class ChunkTokenizer:
    """Token ids of texts by a byte-level BPE of `tokenizers`, computed once per distinct chunk.

    A chunk is a run of white space with the run of other characters after it.
    The tokenizer's own pre-split never joins characters across the start of a
    chunk, so a text's ids are its chunks' ids in order. The exceptions are white
    space outside ASCII, where it could, and the tokenizer's added tokens, which
    stand for one id each; texts with any of them are encoded whole, as the
    tokenizer is. Chunks are told apart by 64-bit hashes of their bytes.
    """

    ODD_SPACE = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values() if t.content]
        self.odd = re.compile("|".join([self.ODD_SPACE, *map(re.escape, added)]))
        self.added = [t.encode() for t in added]
        self._clear()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Adds new chunks; those that begin with white space and end otherwise are encoded together in long texts and cut at their bytes."""
        count = np.zeros(len(chunks), np.int64)
        parts: list[np.ndarray] = []
        texts = [c.decode("utf-8") for c in chunks]
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size < 100_000 and texts[b][0] in WHITE and texts[b - 1][-1] not in WHITE:
                size += len(texts[b])
                b += 1
            self.model.encode_special_tokens = True  # no chunk may reach into another; texts with added tokens are encoded whole anyway
            e = self.model.encode("".join(texts[a:b]), add_special_tokens=False)
            self.model.encode_special_tokens = False
            parts.append(np.array(e.ids, np.uint32))
            ends = np.cumsum(np.fromiter(map(len, texts[a:b]), np.int64, b - a))
            at = np.array([o[0] for o in e.offsets], np.int64)
            count[a:b] = np.bincount(np.searchsorted(ends, at, "right"), minlength=b - a)
            a = b
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *parts])
        self.keys, self.start, self.count = (np.concatenate(x) for x in ((self.keys, keys), (self.start, start), (self.count, count)))
        order = np.argsort(self.keys)
        self.keys, self.start, self.count = self.keys[order], self.start[order], self.count[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a slice (see kernels.slices)."""
        raw = buf.tobytes()
        starts, ends, at = words(buf, off)
        # a chunk reaches from the last word's end (or the row's start) to its own word's end; white space at a row's end is one too
        row_of = np.repeat(np.arange(len(off) - 1), np.diff(at))
        first = np.empty(len(ends), np.int64)
        if len(ends):
            first[1:] = ends[:-1]
            first[0] = 0
            first = np.maximum(first, off[row_of])
        last_end = np.where(np.diff(at) > 0, ends[np.maximum(at[1:] - 1, 0)] if len(ends) else 0, off[:-1])
        tails = np.flatnonzero(last_end < off[1:])
        c_row = np.concatenate([row_of, tails])
        c_a, c_b = np.concatenate([first, last_end[tails]]), np.concatenate([ends, off[1:][tails]])
        order = np.lexsort((c_a, c_row))
        c_row, c_a, c_b = c_row[order], c_a[order], c_b[order]
        keys, where, inverse = np.unique(span_hashes(buf, c_a, c_b, fold=False), return_index=True, return_inverse=True)
        if len(self.ids) > MEMO_IDS:
            self._clear()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            self._learn(keys[new], [raw[a:b] for a, b in zip(c_a[where[new]].tolist(), c_b[where[new]].tolist())])
        slot = np.searchsorted(self.keys, keys)[inverse]
        start, count = self.start[slot], self.count[slot]
        done = np.cumsum(count)
        flat = self.ids[np.repeat(start - (done - count), count) + np.arange(done[-1] if len(done) else 0)]
        bounds = np.concatenate([[0], done])[np.searchsorted(c_row, np.arange(len(off)))]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def encode_column(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Token ids of every row of an Arrow string column, null as empty; documents of odd white space or added tokens are encoded whole."""
    t = _tokenizer(path)
    for a, b, buf, off in slices(column):
        ids = t.encode(buf, off)
        # the first byte of each odd white space: 0x1c-0x1f, 0xc2, 0xe1, 0xe2 or 0xe3
        hint = np.isin(buf, np.array([0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
        rows = np.unique(np.searchsorted(off, np.flatnonzero(hint), "right") - 1).tolist()
        raw = buf.tobytes()
        if any(x in raw for x in t.added):
            rows = range(b - a)
        for i in rows:
            text = raw[off[i] : off[i + 1]].decode("utf-8")
            if t.odd.search(text):
                ids[i] = t.whole(text)
        yield from ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    head = n % capacity or capacity
    return [(0, min(head, n))] + [(a, capacity) for a in range(head, n, capacity)]


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            held = 0

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)]
                return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

            for doc_id, ids in zip(doc_ids, encode_column(batch.column("text"), path)):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    piece = ids[a : a + n]
                    rows.append((doc_id, k, a, n, zlib.crc32(piece.tobytes())) + ((piece.astype(np.int32),) if keep_ids else ()))
                    held += n
                if len(rows) >= 20_000 or keep_ids and held > 1_000_000:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return run


def _place(plan_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[list[int]]] = {int(k): v for k, v in json.loads(plan_json).items()}
        tables = {k: np.array(v, np.int64) for k, v in by.items()}
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                t, r = tables[n], rank[rows]
                k = np.searchsorted(t[:, 0], r, "right") - 1
                j = r - t[k, 0]
                seq[rows] = t[k, 1] + j // t[k, 2]
                off[rows] = t[k, 3] + n * (j % t[k, 2])
            cols = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            yield pa.record_batch(cols | {"sequence_id": pa.array(seq), "offset": pa.array(off)})

    return run


def _bases(counts: DataFrame) -> DataFrame:
    """(length, salt, base): how many pieces of a length are in lesser salts, from counts (length, salt, n).

    Summed in blocks of SALT_BLOCK salts, then over the blocks, so that no task holds all salts of a frequent length.
    """
    blocks = counts.withColumn("block", F.floor(F.col("salt") / SALT_BLOCK))
    less = lambda order, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = blocks.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", less("block", "length").alias("above"))
    return blocks.withColumn("base", less("salt", "length", "block")).join(above.hint("merge"), ["length", "block"]).select("length", "salt", (F.col("base") + F.col("above")).alias("base"))


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    Null and empty texts are the single id 0. Every row of docs is packed;
    repeated rows and rows with a null id are documents of their own. Other
    columns of docs are not read. An empty table gives an empty result. The
    number of sequences is that of best-fit decreasing over all pieces.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = table(rows.mapInArrow(_pieces(tokenizer_path, capacity, keep_ids), kinds), "pieces")
    counts = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    by: dict[int, list[list[int]]] = {}
    for r in runs:
        by.setdefault(r.length, []).append([r.first, r.bin, r.each, r.offset])
    salts = max(1, sum(histogram.values()) // RANK_GROUP)
    salted = pieces.withColumn("salt", bucket_of(F.concat_ws(":", "doc_id", "piece"), salts))
    bases = _bases(table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "salts"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    # merged, not broadcast: the rows lie by length and salt already, and the bases grow with the corpus
    ranked = salted.withColumn("rank", inside).join(bases.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = pieces.columns
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(_place(json.dumps(by)), kinds + ", sequence_id long, offset long")
