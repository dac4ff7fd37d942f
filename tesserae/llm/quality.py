"""Quality: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

A text's features are computed once, for all documents; labels are joined to
features, never to texts. Every feature is cut into bins at quantiles. Boosting
goes round the features; at each step a tree of at most three leaves over one
feature's bins is added to that feature's lookup table. Then the pairs whose
residuals a small grid explains best get tables of their own in the same way.
A score is the logistic of the summed table entries, found by bin for a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import slices, span_hashes, words
from .toxicity import labelled_sample

FEATURES = (
    "log_words", "word_bytes", "line_words", "distinct_words", "repeated_next", "repeated_lines", "upper", "digits", "shouts", "symbols", "bars", "stops", "other_bytes",
)
TRAIN_ROWS = 30_000
THRESHOLD = 0.3
BINS, GRID, PAIRS = 24, 6, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15


def _class(chars: str | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = 1
    return out


_CLASSES = {
    "upper": _class(range(65, 91)), "letters": _class([*range(65, 91), *range(97, 123)]), "digits": _class(range(48, 58)), "shouts": _class("!?"),
    "symbols": _class("#$%&*@^~_=+<>{}[]\\/"), "bars": _class("|"), "stops": _class(".,;:"), "other_bytes": _class(range(128, 256)),
}


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Feature matrices (rows x FEATURES) of a string column, slice by slice; a null or empty text has zeros."""
    for a, b, buf, off in slices(column):
        n = b - a
        size = np.maximum(np.diff(off), 1)
        share = {}
        for name, lut in _CLASSES.items():
            acc = np.concatenate([[0], np.cumsum(lut[buf], dtype=np.int64)])
            share[name] = np.diff(acc[off])
        starts, ends, at = words(buf, off)
        w = span_hashes(buf, starts, ends, fold=False)
        count = np.diff(at)
        some = np.maximum(count, 1)
        same = np.concatenate([[0], np.cumsum(np.concatenate([w[1:] == w[:-1], [False]]))]) if len(w) else np.zeros(1, np.int64)
        last = np.maximum(at[1:] - 1, at[:-1])
        breaks = np.flatnonzero(buf == 10)
        cut = np.unique(np.concatenate([off, breaks, breaks + 1]))
        l0, l1 = cut[:-1], cut[1:]
        line = buf[l0] != 10 if len(l0) else np.zeros(0, bool)
        l0, l1 = l0[line], l1[line]
        lh = span_hashes(buf, l0, l1, fold=False)
        lat = np.searchsorted(l0, off)
        distinct, lines_kept = np.zeros(n), np.zeros(n)
        for i in range(n):
            distinct[i] = len(set(w[at[i] : at[i + 1]].tolist()))
            lines_kept[i] = len(set(lh[lat[i] : lat[i + 1]].tolist()))
        lines = np.maximum(np.diff(lat), 1)
        m = np.zeros((n, len(FEATURES)))
        columns = {
            "log_words": np.log1p(count), "word_bytes": np.add.reduceat(np.append(ends - starts, 0), at[:-1]) * (count > 0) / some, "line_words": count / lines,
            "distinct_words": distinct / some, "repeated_next": (same[last] - same[at[:-1]]) / some, "repeated_lines": 1 - np.where(np.diff(lat) > 0, lines_kept, 1) / lines,
            "upper": share["upper"] / np.maximum(share["letters"], 1),
        } | {k: share[k] / size for k in ("digits", "shouts", "symbols", "bars", "stops", "other_bytes")}
        for k, name in enumerate(FEATURES):
            m[:, k] = columns[name]
        m[count == 0] = 0
        yield m


@dataclass
class Model:
    """cuts[f]: bin borders; tables[f]: a value per bin; pairs: ((f, g), borders, borders, table)."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]

    def logits(self, m: np.ndarray) -> np.ndarray:
        z = np.full(len(m), self.bias)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(c, m[:, f], "right")]
        for (f, g), cf, cg, t in self.pairs:
            z += t[np.searchsorted(cf, m[:, f], "right"), np.searchsorted(cg, m[:, g], "right")]
        return z


def _borders(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of gradient and hessian sums by bin."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        options = [(*_best_split(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, k, a, b = max(options)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def train(m: np.ndarray, labels: np.ndarray) -> Model:
    """Fits the model; with one label only, every score is the smoothed share of label 1."""
    y = (np.asarray(labels) > 0).astype(float)
    bias = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    k = m.shape[1]
    if not len(y) or y.min() == y.max():
        return Model(bias, [np.empty(0)] * k, [np.zeros(1)] * k, [])
    cuts = [_borders(m[:, f], BINS) for f in range(k)]
    bins = [np.searchsorted(c, m[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), bias)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = gradients()
            n = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, minlength=n), np.bincount(bins[f], h, minlength=n))
            tables[f] += step
            z += step[bins[f]]
    coarse = [_borders(m[:, f], GRID) for f in range(k)]
    cells = [np.searchsorted(c, m[:, f], "right") for f, c in enumerate(coarse)]
    g, h = gradients()
    explained = []
    for f, e in combinations(range(k), 2):
        cell = cells[f] * GRID + cells[e]
        gs, hs = np.bincount(cell, g, minlength=GRID * GRID), np.bincount(cell, h, minlength=GRID * GRID)
        explained.append((float((gs**2 / (hs + 1)).sum()), f, e))
    chosen = sorted(explained, reverse=True)[:PAIRS]
    grids = {(f, e): np.zeros((GRID, GRID)) for _, f, e in chosen}
    for _ in range(PAIR_ROUNDS):
        for (f, e), t in grids.items():
            g, h = gradients()
            cell = cells[f] * GRID + cells[e]
            gs, hs = (np.bincount(cell, x, minlength=GRID * GRID).reshape(GRID, GRID) for x in (g, h))
            # a tree of two levels: one cut of f and one cut of e on either side of it, by their joint gain
            sides = lambda at: (slice(0, at), slice(at, GRID))
            at = max(range(1, GRID), key=lambda at: sum(_best_split(gs[r].sum(0), hs[r].sum(0))[0] + gs[r].sum() ** 2 / (hs[r].sum() + 1) for r in sides(at)))
            step = np.zeros((GRID, GRID))
            for rows in sides(at):
                step[rows] = RATE * _tree(gs[rows].sum(0), hs[rows].sum(0))
            t += step
            z += step[cells[f], cells[e]]
    return Model(bias, cuts, tables, [((f, e), coarse[f], coarse[e], t) for (f, e), t in grids.items()])


def with_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f array<double>) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for m in features(batch.column("text")):
                flat = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, len(m)), "f": flat})
                a += len(m)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, f array<double>")


def fit(featured: DataFrame, labels: DataFrame, use: Column, label: str = "quality") -> Model:
    """The model of a bounded labelled sample; a label of 1 or more counts as 1."""
    rows = labelled_sample(featured, labels, label, use, TRAIN_ROWS).select("doc_id", "f", F.col("_label").cast("long").alias("y")).sort("doc_id", "f").toArrow()
    f = rows.column("f").combine_chunks()
    m = f.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return train(m, rows.column("y").to_numpy())


def score(featured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; scores are from 0 to 1, and rows without words get that of all-zero features."""
    shared = featured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            z = shared.value.logits(m) if len(m) else np.empty(0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    kind = featured.schema["doc_id"].dataType.simpleString()
    return featured.select("doc_id", "f").mapInArrow(run, f"doc_id {kind}, score double")
