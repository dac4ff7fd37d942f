"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes at most TRAIN_ROWS labelled rows (least hashes of doc_id, one row
to an id). Their n-grams are counted by label on the executors, in RANGES of the
hash; the driver gets the best n-grams of each range and, for each row, which of
the kept ones it has, never a text. An
n-gram's feature is whether a text has it, times r = log(share of texts with it
among those labelled 1 / share among those labelled 0), both smoothed; logistic
regression learns one weight per feature. The FEATURES n-grams that tell the
labels apart best are kept. A score is the logistic of bias plus the summed
products of the distinct features in the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import table
from .kernels import mix, slices
from .lm import _sorted_packed, _sorted_unpacked, packed, unpacked

ORDERS = (4, 5, 6, 7)
TRAIN_ROWS = 6000
FEATURES = 2000
#: Weight of the squared weights against the summed log loss.
RIDGE = 0.3
MIN_ROWS = 3
THRESHOLD = 0.7
#: Ranges of the hash in which n-grams are counted.
RANGES = 32
#: Tasks that the sample is dealt to.
SAMPLE_TASKS = 32
#: Counts that a task holds before it hands them on.
_HELD = 2_000_000
_BITS = 21
_CHARS = 0x10000
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(_CHARS)], np.uint32)
_M = np.uint64(0xD6E8FEB86659FD93)


def _codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a slice, white space as one kind, and the row offsets in code points."""
    head = (buf & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(head)])[off]
    codes = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    low = _LOWER[np.minimum(codes, _CHARS - 1)]
    codes = np.where(codes < _CHARS, low, codes)
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes, at


def _grams(codes: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n-gram that begins at each code point) for each order; those that reach over a row's end included."""
    h = np.zeros(len(codes), np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(orders) + 1):
        if n > len(codes):
            return
        h = h[: len(codes) - n + 1] * _M
        h += c[n - 1 :]
        if n in orders:
            yield n, h * np.uint64(2 * n + 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at, 0) if len(at) else counts


def gram_counts(column: pa.Array, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted n-gram hashes, how many rows of label 0 and of label 1 have each) of the orders of about _HELD n-grams at a time."""
    for a, b, buf, off in slices(column):
        codes, at = _codes(buf, off)
        for n, h in _grams(codes):
            h = mix(h)
            held, ones, size = [], [], 0
            for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                g = np.unique(h[x : max(x, y - n + 1)])
                held.append(g)
                ones.append(np.full(len(g), labels[a + i], np.int64))
                size += len(g)
                if size >= _HELD or i == b - a - 1:
                    y1 = np.concatenate(ones)
                    yield _summed(np.concatenate(held), np.stack([1 - y1, y1], 1))
                    held, ones, size = [], [], 0


def _best(keys: np.ndarray, counts: np.ndarray, zeros: int, ones: int) -> tuple[np.ndarray, np.ndarray]:
    """The FEATURES n-grams that tell the labels apart best; ties to the lesser hash."""
    keep = np.flatnonzero(counts.sum(1) >= MIN_ROWS)
    keys, counts = keys[keep], counts[keep]
    best = np.lexsort((keys, -_llr(counts[:, 1], counts[:, 0], ones, zeros)))[:FEATURES]
    return keys[best], counts[best]


def _range_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(RANGES) >> np.uint64(32)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, y) -> packed counts (p, keys, zeros, ones) by range of the hash."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        cut = np.searchsorted(_range_of(keys), np.arange(RANGES + 1))
        live = [p for p in range(RANGES) if cut[p] < cut[p + 1]]
        part = lambda x: [packed(x[cut[p] : cut[p + 1]].astype(np.uint64)) for p in live]
        return pa.record_batch(
            {
                "p": pa.array(live, pa.int32()), "keys": pa.array([_sorted_packed(keys[cut[p] : cut[p + 1]]) for p in live], pa.binary()),
                "zeros": pa.array(part(counts[:, 0]), pa.binary()), "ones": pa.array(part(counts[:, 1]), pa.binary()),
            }
        )

    for batch in batches:
        for keys, counts in gram_counts(batch.column("text"), batch.column("y").to_numpy()):
            held.append((keys, counts))
            size += len(keys)
            if size >= _HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _chosen(zeros: int, ones: int):
    """Packed counts, sorted by range -> the best n-grams of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, (np.empty(0, np.uint64), np.empty((0, 2), np.int64))

        def out() -> pa.RecordBatch:
            keys, counts = _best(*total, zeros, ones)
            return pa.record_batch({"g": keys.view(np.int64), "q": counts[:, 0].copy(), "p": counts[:, 1].copy()})

        for batch in batches:
            for row in batch.to_pylist():
                if row["p"] != at:
                    yield out()
                    at, total = row["p"], (total[0][:0], total[1][:0])
                keys, counts = _sorted_unpacked(row["keys"]), np.stack([unpacked(row["zeros"]), unpacked(row["ones"])], 1).astype(np.int64)
                total = _summed(np.concatenate([total[0], keys]), np.concatenate([total[1], counts]))
        yield out()

    return run


@dataclass
class Model:
    """grams: sorted hashes of the kept n-grams; weights: learned weight times log-count ratio."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.flags = np.zeros(1 << _BITS, bool)
        self.flags[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, row within them, slot) of each kept n-gram that a row has, slice by slice."""
        for a, b, buf, off in slices(column):
            codes, at = _codes(buf, off)
            pairs = [np.empty(0, np.int64)]
            for n, h in _grams(codes) if len(self.grams) else ():
                h = mix(h)
                hit = np.flatnonzero(self.flags[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(self.grams, h[hit]), len(self.grams) - 1)
                ok = self.grams[slot] == h[hit]
                hit, slot = hit[ok], slot[ok]
                row = np.searchsorted(at, hit, "right") - 1
                inside = hit + n <= at[row + 1]
                pairs.append(row[inside] * len(self.grams) + slot[inside])
            pair = np.unique(np.concatenate(pairs))
            yield a, b, pair // max(1, len(self.grams)), pair % max(1, len(self.grams))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for a, b, row, slot in self.hits(column):
            total = self.bias + np.bincount(row, self.weights[slot], minlength=b - a)
            out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


def _llr(p: np.ndarray, q: np.ndarray, np_: int, nq: int) -> np.ndarray:
    """Log-likelihood ratio of presence against the label."""

    def part(k: np.ndarray, n: int) -> np.ndarray:
        f = np.clip(k / n, 1e-9, 1 - 1e-9)
        return k * np.log(f) + (n - k) * np.log(1 - f)

    return part(p, np_) + part(q, nq) - part(p + q, np_ + nq)


def prior(zeros: int, ones: int) -> float:
    return float(np.log((ones + 0.5) / (zeros + 0.5))) if zeros + ones else -30.0


def ratios(counts: np.ndarray, zeros: int, ones: int) -> np.ndarray:
    """Log-count ratios of n-grams from their (label 0, label 1) counts."""
    return np.log((counts[:, 1] + 0.5) / (ones + 1)) - np.log((counts[:, 0] + 0.5) / (zeros + 1))


def learn(grams: np.ndarray, r: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression on the features (row, col), each scaled by its ratio."""
    w, bias = np.full(len(grams), 0.01), prior(int((y == 0).sum()), int((y == 1).sum()))
    m = np.zeros(len(w) + 1)
    v = np.zeros(len(w) + 1)
    for t in range(1, 301):
        z = bias + np.bincount(row, (w * r)[col], minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(col, err[row], minlength=len(w)) * r / len(y) + RIDGE * w / len(y), err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(grams, w * r, float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """(docs' row, label) of at most `bound` labelled ids that `use` allows, those of least hash: one row to an id, the least one if it has several.
    Ids of several labels count once, by the greatest."""
    ids = labels.filter(use & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    others = [c for c in docs.columns if c != doc_id]
    rows = docs.join(F.broadcast(ids.withColumnRenamed("doc_id", doc_id)), doc_id).groupBy(doc_id).agg(F.max("_label").alias("_label"), F.min(F.struct(*others)).alias("_row"))
    return rows.select(doc_id, *[F.col(f"_row.{c}").alias(c) for c in others], "_label")


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> Model:
    """The model of the labelled sample; a label of 1 or more counts as 1. With one label only, every score is the smoothed share of label 1."""
    rows = labelled_sample(docs.select(doc_id, text), labels, label, use, TRAIN_ROWS, doc_id)
    rows = rows.select(F.col(doc_id).alias("i"), F.col(text).alias("text"), (F.coalesce(F.col("_label"), F.lit(0)) > 0).cast("long").alias("y"))
    sample = table(rows.repartition(SAMPLE_TASKS, "i"), "sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    zeros, ones = n.get(0, 0), n.get(1, 0)
    if not zeros or not ones:
        return Model(np.empty(0, np.uint64), np.empty(0), prior(zeros, ones))
    counts = sample.select("text", "y").mapInArrow(_counted, "p int, keys binary, zeros binary, ones binary")
    best = counts.repartition(RANGES, "p").sortWithinPartitions("p").mapInArrow(_chosen(zeros, ones), "g long, q long, p long").toArrow()  # at most RANGES * FEATURES rows
    grams, by_label = best.column("g").to_numpy().view(np.uint64), np.stack([best.column("q").to_numpy(), best.column("p").to_numpy()], 1)
    grams, by_label = _best(grams, by_label, zeros, ones)
    order = np.argsort(grams)
    grams, r = grams[order], ratios(by_label[order], zeros, ones)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, np.zeros(len(shared.value)), 0.0)
        for batch in batches:
            for a, b, row, slot in model.hits(batch.column("text")):
                at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32)))
                yield pa.record_batch({"i": batch.column("i").slice(a, b - a), "y": batch.column("y").slice(a, b - a), "slots": lists})

    kind = sample.schema["i"].dataType.simpleString()
    found = sample.mapInArrow(hits, f"i {kind}, y long, slots array<int>").sort("i").toArrow()  # at most TRAIN_ROWS rows of FEATURES slots
    slots = found.column("slots").combine_chunks()
    row = np.repeat(np.arange(len(slots)), np.diff(slots.offsets.to_numpy()))
    return learn(grams, r, row, slots.flatten().to_numpy(zero_copy_only=False), found.column("y").to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Adds a double column of scores from 0 to 1; null and empty texts get the logistic of the bias. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.weights, model.bias))
    docs = docs.select([c for c in docs.columns if c != name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            yield batch.append_column(name, pa.array(m.scores(batch.column(text)), pa.float64()))

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def drop_toxic(docs: DataFrame, labels: DataFrame, use: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all columns; learned from labels of rows in docs."""
    model = fit(docs, labels, F.lit(True) if use is None else use)
    return score(docs, model, name="_toxicity").filter(F.col("_toxicity") < threshold).drop("_toxicity")
