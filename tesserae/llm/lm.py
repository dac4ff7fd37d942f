"""Language-model scores by deleted interpolation of word bigrams.

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), with weights l by
the frequency bucket of the context v. The weights are learned by expectation-
maximisation on deleted counts: each training token is held out in turn, that
is, its own occurrence is taken off all counts that predict it.

Counting never moves a row per token. The text is dealt into chunks, which are
written once: both passes read the same ones, however often a task is tried. A
chunk asks for its distinct words and bigrams: packed, sorted hashes go to the
owners of their hash ranges, which sum the training counts of all chunks and
answer each chunk with the totals in the order asked. A hot word is one entry
per chunk, so no key is skewed. There are as many owners as the number of
entries needs at OWNER_ENTRIES each, so a task's memory does not grow with the
input. A chunk's documents meet the answers in one task, which writes the counts
that their tokens need; weights and scores are computed from those.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partition_keys, table
from .kernels import mix, slices, span_hashes, words

CHUNK_BYTES = 12_000_000
#: An owner sums about this many entries (16 bytes each) of all chunks.
OWNER_ENTRIES = 2_000_000
#: Documents per packed row of counts hold about this many tokens.
ROW_TOKENS = 100_000
BUCKETS = 24
#: Probabilities are cut into bins of a quarter of an octave for the weights.
BINS = 160
EM_STEPS = 60
_END, _START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_M = np.uint64(0xA0761D6478BD642F)


def packed(a: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed byte planes."""
    a = np.ascontiguousarray(a, "<u8")
    planes = a.view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    return struct.pack("<BQ", used, len(a)) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    used, n = struct.unpack_from("<BQ", raw)
    out = np.zeros((n, 8), np.uint8)
    if used and n:
        out[:, :used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _sorted_packed(h: np.ndarray) -> bytes:
    return packed(np.diff(h, prepend=np.uint64(0)))


def _sorted_unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    """The owner of a hash's range; grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice's rows, each row's words and an end, and tokens by row."""
    starts, ends, at = words(buf, off)
    h = span_hashes(buf, starts, ends)
    return np.insert(h, at[1:], _END), np.diff(at) + 1


def _contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(lengths) - lengths] = _START
    return out


def bigrams(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(_contexts(tokens, lengths) * _M + tokens)


_CHUNKS = "chunk long, entries long, ids array<long>, train binary, lengths binary, words binary, places binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for about CHUNK_BYTES of text: a number of its own, its ids, which of them are in training, row lengths, distinct words, and tokens as places among those."""
    number = TaskContext.get().partitionId() << 32

    def out(ids: list, parts: list[tuple]) -> pa.RecordBatch:
        train, lengths, tokens = (np.concatenate(x) for x in zip(*parts))
        keys, places = np.unique(tokens, return_inverse=True)
        pairs = len(np.unique(bigrams(tokens, lengths)))
        return pa.record_batch(
            {
                "chunk": pa.array([number], pa.int64()), "entries": pa.array([len(keys) + pairs], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "train": pa.array([np.packbits(train).tobytes()], pa.binary()), "lengths": pa.array([packed(lengths)], pa.binary()),
                "words": pa.array([_sorted_packed(keys)], pa.binary()), "places": pa.array([packed(places)], pa.binary()),
            }
        )

    ids: list = []
    parts: list[tuple] = []
    size = 0
    for batch in batches:
        for a, b, buf, off in slices(batch.column("text")):
            ids += batch.column("doc_id").slice(a, b - a).to_pylist()
            parts.append((batch.column("train").slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool), *_tokens(buf, off)[::-1]))
            size += len(buf) + b - a
            if size >= CHUNK_BYTES:
                yield out(ids, parts)
                number, ids, parts, size = number + 1, [], [], 0
    if parts:
        yield out(ids, parts)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether in training, tokens by row, distinct words, places of the tokens among them) of a chunk's row."""
    lengths = unpacked(row["lengths"]).astype(np.int64)
    train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: len(lengths)].astype(bool)
    return train, lengths, _sorted_unpacked(row["words"]), unpacked(row["places"]).astype(np.int64)


def _counted(h: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and how often each is among the training tokens."""
    order = np.argsort(h)
    h, train = h[order], train[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(train.astype(np.uint64), at)


def _requests(owners: int):
    deal = partition_keys(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            chunk, (train, lengths, words, places) = row["chunk"], _read(row)
            in_train = np.repeat(train, lengths)
            once = np.bincount(places, in_train, minlength=len(words)).astype(np.uint64)
            for kind, (keys, counts) in ((1, (words, once)), (2, _counted(bigrams(words[places], lengths), in_train))):
                cut = np.searchsorted(_owner(keys, owners), np.arange(owners + 1))
                live = [p for p in range(owners) if cut[p] < cut[p + 1]]
                yield pa.record_batch(
                    {
                        "deal": pa.array(deal[live], pa.int32()), "p": pa.array(live, pa.int32()), "chunk": pa.array([chunk] * len(live), pa.int64()), "kind": pa.array([kind] * len(live), pa.int32()),
                        "keys": pa.array([_sorted_packed(keys[cut[p] : cut[p + 1]]) for p in live], pa.binary()),
                        "counts": pa.array([packed(counts[cut[p] : cut[p + 1]]) for p in live], pa.binary()),
                    }
                )

    return run


_REQUESTS = "deal int, p int, chunk long, kind int, keys binary, counts binary"
_ANSWERS = "chunk long, kind int, p int, counts binary, types long, tokens long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums each owner's counts over all chunks; answers every chunk, and tells its words (types and tokens) once with chunk -1."""

    def out(p: int, kind: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every = np.concatenate([k for _, k, _ in rows])
        counts = np.concatenate([c for _, _, c in rows])
        keys, inverse = np.unique(every, return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, inverse, counts)
        cut = np.cumsum([0] + [len(k) for _, k, _ in rows])
        given = total[inverse]
        blobs = [packed(given[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        words_in, tokens_in = (int((total > 0).sum()), int(total.sum())) if kind == 1 else (0, 0)
        n = len(rows) + 1
        return pa.record_batch(
            {
                "chunk": pa.array([-1] + [c for c, _, _ in rows], pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "p": pa.array([p] * n, pa.int32()),
                "counts": pa.array([b""] + blobs, pa.binary()), "types": pa.array([words_in] + [0] * (n - 1), pa.int64()), "tokens": pa.array([tokens_in] + [0] * (n - 1), pa.int64()),
            }
        )

    held: tuple[int, int] | None = None
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for p, chunk, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("p", "chunk", "kind", "keys", "counts"))):
            if (p, kind) != held:
                if held:
                    yield out(*held, rows)
                held, rows = (p, kind), []
            rows.append((chunk, _sorted_unpacked(keys), unpacked(counts)))
    if held:
        yield out(*held, rows)


_COUNTS = "ids array<long>, train binary, lengths binary, unigrams binary, bigrams binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk, its documents before the answers -> the counts of each token and of its bigram."""

    def out(doc: dict, answers: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        train, lengths, keys, places = _read(doc)
        totals = {k: np.concatenate([unpacked(b) for b in answers[k]]) for k in (1, 2)}
        tokens = keys[places]
        pairs, where = np.unique(bigrams(tokens, lengths), return_inverse=True)
        if len(totals[1]) != len(keys) or len(totals[2]) != len(pairs):
            raise RuntimeError("a chunk and its answers differ")
        one, two = totals[1][places], totals[2][where]
        at = np.concatenate([[0], np.cumsum(lengths)])
        a = 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(at, at[a] + ROW_TOKENS, "right")) - 1)
            yield pa.record_batch(
                {
                    "ids": pa.array([doc["ids"][a:b]], pa.list_(pa.int64())), "train": pa.array([np.packbits(train[a:b]).tobytes()], pa.binary()), "lengths": pa.array([packed(lengths[a:b])], pa.binary()),
                    "unigrams": pa.array([packed(one[at[a] : at[b]])], pa.binary()), "bigrams": pa.array([packed(two[at[a] : at[b]])], pa.binary()),
                }
            )
            a = b

    doc: dict | None = None
    answers: dict[int, list[bytes]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if doc:
                    yield from out(doc, answers)
                doc, answers = row, {1: [], 2: []}
            else:
                answers[row["kind"]].append(row["counts"])
    if doc:
        yield from out(doc, answers)


def _rows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = unpacked(row["lengths"]).astype(np.int64)
    train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: len(lengths)].astype(bool)
    one, two = unpacked(row["unigrams"]).astype(np.int64), unpacked(row["bigrams"]).astype(np.int64)
    return lengths, train, one, two, np.cumsum(lengths) - lengths


def _context_counts(one: np.ndarray, first: np.ndarray, starts: int) -> np.ndarray:
    out = np.empty_like(one)
    out[1:] = one[:-1]
    out[first] = starts
    return out


def bucket(c: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context count: 0 if unseen, else 1 + log2, at most BUCKETS - 1."""
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 + quarter octaves below 1."""
    with np.errstate(divide="ignore"):
        q = np.floor(-4 * np.log2(np.maximum(p, 1e-300))).astype(np.int64)
    return np.where(p > 0, 1 + np.clip(q, 0, BINS - 2), 0)


def _bin_value(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 2.0 ** (-(k - 0.5) / 4), 0.0)


def _deleted(n_tokens: int, starts: int):
    """(cell, n): how many training tokens fall in each cell of (context bucket, bin of the deleted bigram estimate, bin of the deleted unigram estimate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * BINS * BINS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, train, one, two, first = _rows(row)
                before = _context_counts(one, first, starts)
                t = np.repeat(train, lengths)
                c1, c2, c12 = before[t] - 1, one[t] - 1, two[t] - 1
                p2 = np.where(c1 > 0, c12 / np.maximum(c1, 1), 0.0)
                cell = (bucket(c1) * BINS + _bin(p2)) * BINS + _bin(c2 / max(n_tokens - 1, 1))
                total += np.bincount(cell, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": at, "n": total[at]})

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, types: int) -> np.ndarray:
    """(BUCKETS, 3): weights of bigram, unigram and uniform estimate by expectation-maximisation on the deleted counts."""
    k, q2, q1 = cells // (BINS * BINS), cells // BINS % BINS, cells % BINS
    p = np.stack([_bin_value(q2), _bin_value(q1), np.full(len(cells), 1 / (types + 1))], 1)
    w = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(EM_STEPS):
        share = w[k] * p
        share /= share.sum(1, keepdims=True)
        got = np.stack([np.bincount(k, share[:, j] * n, minlength=BUCKETS) for j in range(3)], 1).astype(float)
        # one pseudo-count each keeps every weight above zero, so no text has probability 0
        got += np.array([0.0, 0.5, 0.5])
        w = got / got.sum(1, keepdims=True)
    w[0] = [0.0, w[0][1] / w[0][1:].sum(), w[0][2] / w[0][1:].sum()]
    return w


def _scores(n_tokens: int, types: int, starts: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, train, one, two, first = _rows(row)
                before = _context_counts(one, first, starts)
                w = weights[bucket(before)]
                p = w[:, 0] * np.where(before > 0, two / np.maximum(before, 1), 0.0) + w[:, 1] * one / max(n_tokens, 1) + w[:, 2] / (types + 1)
                base = np.log10((one + 1) / (n_tokens + types + 1))
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(~train), "n_tokens": lengths, "n_known": np.add.reduceat((one > 0).astype(np.int64), first),
                        "train_tokens": np.full(len(lengths), n_tokens), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first),
                    }
                )

    return run


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns from the rows whose crc32(doc_id as text) mod folds is not held_out;
    a null id counts as one of those. Tokens are words with A-Z in lower case
    and an end; null and empty texts are the end alone. base_score is the
    add-one unigram's log10 probability, score the interpolated model's. Repeated
    rows count each. Without training rows, N and V are 0 and every score is finite.
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    train = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds != held_out, F.lit(True))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), train.alias("train"), F.col(text).alias("text"))
    chunks = table(rows.mapInArrow(_chunks, _CHUNKS), "chunks")
    size = chunks.agg(F.sum("entries").alias("entries"), F.count("*").alias("chunks")).first()
    owners = max(1, -(-(size["entries"] or 0) // OWNER_ENTRIES))
    asked = chunks.mapInArrow(_requests(owners), _REQUESTS).repartition(owners, "deal").sortWithinPartitions("p", "kind", "chunk")
    answers = table(asked.mapInArrow(_answer, _ANSWERS), "answers")
    totals = answers.filter("chunk = -1").agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).first()
    types, n_tokens = totals["v"] or 0, totals["n"] or 0
    starts = rows.filter("train").select("train").count()
    given = answers.filter("chunk >= 0").select("chunk", "kind", "p", "counts")
    both = chunks.drop("entries").withColumns({"kind": F.lit(0), "p": F.lit(-1)}).unionByName(given, allowMissingColumns=True)
    met = both.repartition(max(1, size["chunks"]), "chunk").sortWithinPartitions("chunk", "kind", "p")
    counts = table(met.mapInArrow(_meet, _COUNTS), "counts")
    cells = counts.mapInArrow(_deleted(n_tokens, starts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS * BINS ** 2 rows
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), types)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counts.mapInArrow(_scores(n_tokens, types, starts, weights), kinds)
