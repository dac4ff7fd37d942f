"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of a vector are dealt into GROUPS of dimensions; each group is a
source with its own local scores (partial inner products), and a candidate's
score is their sum. A source lists a block's candidates by the length of their
part of the vector, longest first: no local score exceeds the product of the
lengths of both parts, so a cutoff ends a list early. Per block of queries:

1. every source scores the head of each of its lists and gives the k best; the
   candidates they name are resolved exactly, and the k-th best exact score so
   far is a lower bound T;
2. T goes to all tasks. A candidate with a total of T or more must have at
   least T / GROUPS in some source, so each source scores its lists up to the
   place where that uniform cutoff is out of reach, and gathers what reaches it;
3. what was gathered is resolved exactly by its other parts, and the k best are ranked.

Candidates never leave the task that reads them. Queries travel as broadcasts of
at most QUERY_BYTES, one pass over the candidates each; what is shuffled are the
lower bounds and the entries that reach the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import bucket_of, table

GROUPS = 2
#: Components of the queries of one pass (8 bytes each); it bounds the broadcast.
QUERY_BYTES = 32_000_000
#: Queries and candidates whose scores are one matrix.
QUERY_BLOCK, ROW_BLOCK = 512, 4096
#: The first phase scores this share of each list.
HEAD = 8
_ENTRIES = "query_id long, vec_id long, score long, tie string"
_EXACT32, _EXACT64, _LONG = 1 << 24, 1 << 53, 1 << 63


def quantised(vec: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null for null vectors and those with null, NaN or infinite components."""
    ok = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    # doubles from 2 ** 53 up are integers already
    floor = lambda y: F.when(F.abs(y) < float(_EXACT64), F.floor(y).cast("double")).otherwise(y)
    return F.when(ok, F.transform(vec, lambda x: floor(x.cast("double") * scale)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles or longs, padded with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=0))), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _common(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices padded to one width, in the smallest type whose inner products are exact: single, double, long or Python integers."""
    d = max(q.shape[1], c.shape[1], 1)
    q, c = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (q, c))
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (q, c)]
    bound = d * most[0] * most[1]
    if bound < _EXACT64:
        kind = np.float32 if bound < _EXACT32 else np.float64
        return q.astype(kind), c.astype(kind)
    if bound < _LONG // 2:
        return q.astype(np.int64), c.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).astype(object), whole(c).astype(object)


def _splits(d: int) -> list[slice]:
    at = np.linspace(0, d, GROUPS + 1).astype(int)
    return [slice(a, b) for a, b in zip(at[:-1], at[1:])]


def _lengths(m: np.ndarray) -> np.ndarray:
    """Lengths of rows, rounded up."""
    return np.sqrt((m.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


def _whole(p: np.ndarray) -> np.ndarray:
    return p if p.dtype == object else p.astype(np.int64)


class _Block:
    """A block of candidates with each source's list: the order of its rows by the length of their part, and those lengths."""

    def __init__(self, ids: np.ndarray, c: np.ndarray):
        self.ids, self.c, self.lists = ids, c, []
        for s in _splits(c.shape[1]):
            size = _lengths(c[:, s])
            order = np.argsort(-size, kind="stable")
            self.lists.append((s, order, size[order]))

    def resolve(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact scores of the pairs (query row, candidate row)."""
        out = [_whole((q[a[i : i + 65536]] * self.c[b[i : i + 65536]]).sum(1)) for i in range(0, len(a), 65536)]
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[np.ndarray, np.ndarray, slice, _Block]]:
    """(query ids, queries, their places, candidates) for every pair of a query block and a block of the task's rows."""
    q_ids, q_m = shared.value
    for batch in batches:
        for a in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(a, ROW_BLOCK)
            q, c = _common(q_m, matrix(part.column("v")))
            block = _Block(part.column("id").to_numpy(), c)
            for x in range(0, len(q_ids), QUERY_BLOCK):
                at = slice(x, x + QUERY_BLOCK)
                yield q_ids[at], q[at], at, block


def _best(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query (row a), ties to the smaller id; sorted by query."""
    order = np.lexsort((ids, -score, a)) if score.dtype != object else np.array(sorted(range(len(a)), key=lambda i: (a[i], -score[i], ids[i])), np.int64)
    rank = np.arange(len(a)) - np.searchsorted(a[order], a[order])
    return order[rank < k]


def _bounds(shared, k: int):
    """Phase one: for each query the k best exact scores among what the heads of this task's lists name, as (q, scores); null beyond 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for q_ids, q, at, block in _blocks(batches, shared):
            named = []
            for s, order, _ in block.lists:
                head = order[: max(k + 1, len(order) // HEAD)]
                local = q[:, s] @ block.c[head][:, s].T
                t = min(k + 1, len(head))  # the query itself may be among them
                if local.dtype == object:
                    named.append(head[np.array([sorted(range(len(head)), key=lambda j: -r[j])[:t] for r in local], np.int64).reshape(len(q), t)])
                else:
                    named.append(head[np.argpartition(local, len(head) - t, axis=1)[:, len(head) - t :]])
            pair = np.unique((np.arange(len(q))[:, None] * len(block.ids) + np.concatenate(named, 1)).ravel())
            a, b = pair // len(block.ids), pair % len(block.ids)
            other = q_ids[a] != block.ids[b]
            a, b = a[other], b[other]
            score = block.resolve(q, a, b)
            keep = _best(a, block.ids[b], score, k)
            a, score = a[keep], score[keep]
            for i in np.unique(a).tolist():
                x, y = np.searchsorted(a, [i, i + 1])
                old = held.get(at.start + i, score[:0])
                held[at.start + i] = np.array(sorted([*old.tolist(), *score[x:y].tolist()], reverse=True)[:k], object)
        fits = lambda x: x if -_LONG <= x < _LONG else None
        keys = sorted(held)
        yield pa.record_batch({"q": pa.array(keys, pa.int64()), "scores": pa.array([[fits(x) for x in held[i].tolist()] for i in keys], pa.list_(pa.int64()))})

    return run


def _shown(score: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Scores as the nearest longs, and for those at either end of the range a text that sorts as their exact value."""
    if score.dtype != object:
        return score, [""] * len(score)
    turned = str.maketrans("0123456789", "9876543210")
    tie = []
    for x in score.tolist():
        digits = str(abs(x)) if not -_LONG < x < _LONG - 1 else ""
        tie.append(digits and (f"{len(digits):06d}{digits}" if x > 0 else f"{len(digits):06d}{digits}".translate(turned)))
    return np.array([max(-_LONG, min(_LONG - 1, x)) for x in score.tolist()], np.int64), tie


def _entries(shared, cuts, k: int):
    """Phases two and three: the task's k best of what reaches the cutoff in some source, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        least, known = cuts.value  # T for each query, and whether there is one

        def shrunk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, ids, score = (np.concatenate(x) for x in zip(*held))
            keep = _best(a, ids, score, k)
            return a[keep], ids[keep], score[keep]

        for q_ids, q, at, block in _blocks(batches, shared):
            low, some = least[at], known[at]
            share = -(-low // GROUPS)  # T / GROUPS rounded up: a total of T has as much in some source
            found = []
            for s, order, sizes in block.lists:
                reach = np.where(some & (share > 0), share / np.maximum(_lengths(q[:, s]), 1e-300), -1.0)
                n = np.searchsorted(-sizes, -reach, "right")
                n[reach < 0] = len(order)
                # queries that read lists to a like depth are scored together
                by_depth = np.argsort(n, kind="stable")
                for part in np.array_split(by_depth, max(1, -(-len(by_depth) // 64))):
                    depth = int(n[part].max(initial=0))
                    if depth:
                        local = q[part][:, s] @ block.c[order[:depth]][:, s].T
                        x, y = np.nonzero((local >= share[part][:, None]) | ~some[part][:, None])
                        found.append(part[x] * len(block.ids) + order[y])
            pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
            a, b = pair // len(block.ids), pair % len(block.ids)
            other = q_ids[a] != block.ids[b]
            a, b = a[other], b[other]
            score = block.resolve(q, a, b)
            stay = ~some[a] | (score >= low[a])
            a, b, score = a[stay], b[stay], score[stay]
            keep = _best(a, block.ids[b], score, k)
            held.append((a[keep] + at.start, block.ids[b[keep]], score[keep].astype(object) if score.dtype == object else score[keep]))
            size += len(keep)
            if size > 500_000:
                held = [shrunk()]
                size = 250_000
        if held:
            a, ids, score = shrunk()
            for i in range(0, len(a), 100_000):
                part = slice(i, i + 100_000)
                clipped, tie = _shown(score[part])
                yield pa.record_batch({"query_id": shared.value[0][a[part]], "vec_id": ids[part], "score": clipped, "tie": pa.array(tie, pa.string())})

    return run


def _pass(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The entries of one block of queries."""
    spark = rows.sparkSession
    got = queries.toArrow()  # at most QUERY_BYTES of components
    ids, m = got.column("id").combine_chunks().to_numpy(), matrix(got.column("v"))
    shared = spark.sparkContext.broadcast((ids, m))
    bounds = rows.mapInArrow(_bounds(shared, k), "q long, scores array<long>").select("q", F.explode("scores").alias("s"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("s")))
    # the k-th best of what is known; scores beyond 64 bits are left out, which makes the bound lower and no result wrong
    low = bounds.filter("s is not null").withColumn("place", place).filter(F.col("place") == k).select("q", "s").toArrow()
    least, known = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = low.column("q").to_numpy()
    least[at], known[at] = low.column("s").to_numpy(), True
    cuts = spark.sparkContext.broadcast((least, known))
    return table(rows.mapInArrow(_entries(shared, cuts, k), _ENTRIES), "entries")


def search(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over rows, ties to the smaller id.

    Both inputs have columns id (long) and v (an array of whole longs or doubles,
    see `quantised`); rows with a null id or v take no part. A row with the
    query's own id is no candidate of it. Shorter vectors count as padded with
    zeros. Fewer than k candidates: all are returned. Components of any finite
    size are multiplied exactly; a score beyond 64 bits has its exact rank and is
    given as the nearest long. Repeated ids among the rows are separate
    candidates; of repeated queries the least vector is asked. Empty inputs give
    an empty result.
    """
    queries = table(queries.select("id", "v").dropna().groupBy("id").agg(F.min("v").alias("v")), "queries")
    rows = rows.select("id", "v").dropna()
    size = queries.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0
    passes = -(-size // QUERY_BYTES)
    found = queries.sparkSession.createDataFrame([], _ENTRIES)
    for p in range(passes):
        found = found.union(_pass(queries.filter(bucket_of(F.col("id"), passes) == p), rows, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tie"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
