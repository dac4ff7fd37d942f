"""Near-duplicate components by fast similarity sketching, banding and exact verification.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Equal
   sets form a class with one representative, so copies cost nothing further.
2. A representative's set is sketched into COORDINATES values and cut into bands
   of ROWS; sets of similarity 0.75 share no band with probability about 1e-6.
3. Sharing a band links representatives to the band's least one; the components
   of these unverified links are families, and every link lies in one family.
4. A family's sets meet in blocks of bounded size. Within a block, and between
   every block and the family's root, all links are verified exactly on full
   sets. Families of several blocks that this leaves in several parts also
   compare across blocks: a set goes to those other blocks where its bands meet
   another part's. No pair leaves a task but as a verified link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import bucket_of, table
from .kernels import mix, shingle_sets, slices
from .sketch import band_keys, sketches

COORDINATES, ROWS = 144, 4
SHINGLE = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: A block holds about this many shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 300_000, 1000
_CELLS = 4_000_000
#: The filter of ids in families has 2 ** 26 bits (8 MB) at any size; when full it lets all rows pass.
FILTER_BITS = 26


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b, buf, off in slices(batch.column("text")):
                sets = shingle_sets(buf, off, width)
                keys = band_keys(sketches(sets, COORDINATES), ROWS)
                n = np.fromiter(map(len, sets), np.int64, b - a)
                sums = np.array([[s.sum(), mix(s).sum()] for s in sets], np.uint64).reshape(-1, 2)
                where = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(where), pa.array(_signed(np.ascontiguousarray(keys[n > 0]).ravel())))
                yield pa.record_batch(
                    {"doc_id": doc_ids.slice(a, b - a), "n": n, "sig_a": _signed(sums[:, 0].copy()), "sig_b": _signed(sums[:, 1].copy()), "keys": lists}
                )

    return run


def _hash_bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place) of each id in a bitmap of 2 ** FILTER_BITS bits."""
    for batch in batches:
        at = _hash_bits(batch.column("rep").to_numpy())
        yield pa.record_batch({"chunk": at >> 15, "place": at & 32767})


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids (column rep), of fixed size whatever their number: it lets all of them pass, and few others while it is sparse."""
    bits = ids.select("rep").mapInArrow(_bitmaps, "chunk long, place long").groupBy("chunk").agg(F.bitmap_construct_agg("place").alias("b"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in bits.toLocalIterator():
        out[r["chunk"] * 4096 : r["chunk"] * 4096 + 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def _sets_of(width: int, shared):
    """(rep, set) of the rows that the shared filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids = batch.column("doc_id").drop_null().to_numpy()
            batch = batch.filter(batch.column("doc_id").is_valid())
            at = _hash_bits(ids)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            for a, b, buf, off in slices(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(buf, off, width)]
                yield pa.record_batch({"rep": batch.column("doc_id").slice(a, b - a), "set": pa.array(sets, pa.binary())})

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray] | None = None, threshold: int = THRESHOLD) -> np.ndarray:
    """Matrix of which sets of left are linked with which of right (left itself, if None), by exact overlap.

    Overlaps are products of 0/1 matrices over the shingles that occur twice or
    more, a bounded number of columns at a time.
    """
    if right is None and len(left) == 2:
        shared = len(np.intersect1d(left[0], left[1], assume_unique=True))
        hit = 100 * shared >= threshold * (len(left[0]) + len(left[1]) - shared)
        return np.array([[True, hit], [hit, True]])
    sets = left + (right or [])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    many = (np.bincount(column) > 1)[column]
    row, column = row[many], column[many]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    k = len(left)
    overlap = np.zeros((k, len(sets) - k if right else k), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(64, _CELLS // len(sets)))
    for a in range(0, columns, width or 1):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        overlap += m[:k] @ (m[k:] if right else m).T
    both = overlap.astype(np.int64)
    union = sizes[:k, None] + (sizes[k:] if right else sizes)[None, :] - both
    return 100 * both >= threshold * union


def _labels(link: np.ndarray) -> np.ndarray:
    """Least index reachable, for a symmetric link matrix."""
    n = len(link)
    label = np.arange(n)
    np.fill_diagonal(link, True)
    while True:
        new = np.where(link, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, of sorted batches."""
    held: tuple | None = None
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != held:
                if rows:
                    yield held, rows
                held, rows = key, []
            rows.append(row)
    if rows:
        yield held, rows


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))})


def _sets(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["set"], np.uint64) for r in rows]


def _within(threshold: int):
    """(rep, least rep of its part of the block) for each row; the root, which is in every block, links blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _groups(batches, ["family", "block"]):
            rows.sort(key=lambda r: r["rep"])
            label = _labels(linked(_sets(rows), None, threshold))
            out += [(r["rep"], rows[j]["rep"], r["family"], r["blocks"]) for r, j in zip(rows, label.tolist())]
            if len(out) > 20_000:
                yield _rows(["a", "b", "family", "blocks"], out)
                out = []
        yield _rows(["a", "b", "family", "blocks"], out)

    return run


def _between(threshold: int):
    """Links between two blocks of one family, of parts that are not known as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["family", "low", "high"]):
            left, right = ([r for r in rows if r["block"] == r[x]] for x in ("low", "high"))
            if left and right:
                link = linked(_sets(left), _sets(right), threshold)
                link &= np.array([r["part"] for r in left])[:, None] != np.array([r["part"] for r in right])[None, :]
                a, b = np.nonzero(link)
                parts = sorted({(left[i]["part"], right[j]["part"]) for i, j in zip(a.tolist(), b.tolist())})
                yield _rows(["a", "b"], parts)

    return run


def _routes(classes: DataFrame, apart: DataFrame) -> DataFrame:
    """(rep, other): the other blocks of its family in which a band of the set is also one of another part. apart: (rep, family, part, block)."""
    banded = table(classes.select("rep", "keys").join(apart, "rep").select("rep", "family", "part", "block", F.explode("keys").alias("key")), "banded")
    held = banded.groupBy("family", "key", "block").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    several = held.groupBy("family", "key").agg(F.min("least").alias("x"), F.max("most").alias("y"), F.count("*").alias("c")).filter("x <> y and c > 1").select("family", "key")
    held = held.join(several, ["family", "key"]).withColumnRenamed("block", "other")
    met = banded.join(held, ["family", "key"]).filter("other <> block and (least <> part or most <> part)")
    return table(met.select("rep", "other").distinct(), "routes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A set is the distinct shingles of `width` words of a text with A-Z in lower
    case; with fewer words, the whole sequence is one; without words, or null,
    the set is empty and linked with nothing. Rows are linked if 100 * shared >=
    threshold * union. component_id is the least id reachable; kept is doc_id =
    component_id. Repeated rows are copies of one another; an id
    with several texts stands for one of them. Rows with a null id
    link nothing: their component_id is null and kept is false. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = table(rows.mapInArrow(_signatures(width), "doc_id long, n long, sig_a long, sig_b long, keys array<long>"), "signatures")
    named = signed.filter("n > 0 and doc_id is not null")
    classes = table(named.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes")

    banded = classes.select("rep", F.explode("keys").alias("key"))
    hubs = table(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("key", "hub"), "hubs")
    near = banded.join(hubs, "key").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    families = table(components(near).toDF("rep", "family"), "families")

    members = classes.select("rep", "n").join(families, "rep")
    sizes = members.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    sizes = table(sizes.select("family", F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("docs") / BLOCK_DOCS)).cast("int").alias("blocks")), "sizes")
    placed = table(table(members.select("rep", "family"), "members").join(sizes, "family").withColumn("block", bucket_of(F.col("rep"), F.col("blocks")).cast("int")), "placed")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(placed))
    sets = rows.mapInArrow(_sets_of(width, bits), "rep long, set binary").join(placed, "rep").dropDuplicates(["rep"])
    sets = table(sets.select("rep", "family", "blocks", "block", "set"), "sets")

    first = F.when(F.col("rep") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    blocks = sets.withColumn("block", F.explode(first)).repartition("family", "block").sortWithinPartitions("family", "block")
    parts = table(blocks.mapInArrow(_within(threshold), "a long, b long, family long, blocks long"), "parts")

    whole = parts.filter("blocks = 1").select(F.col("a").alias("rep"), F.col("b").alias("part"))
    split = parts.filter("blocks > 1")
    if not split.isEmpty():
        known = table(components(split.select("a", "b")).toDF("rep", "part"), "known")
        loose = split.select("family", F.col("a").alias("rep")).distinct().join(known, "rep", "left").select("rep", "family", F.coalesce("part", "rep").alias("part"))
        loose = table(loose, "loose")
        torn = table(loose.groupBy("family").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("family"), "torn")
        if not torn.isEmpty():
            apart = table(loose.join(torn, "family"), "apart")
            again = sets.join(apart.select("rep", "part"), "rep").join(_routes(classes, apart.join(placed.select("rep", "block"), "rep")), "rep")
            again = again.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
            again = again.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
            more = table(again.mapInArrow(_between(threshold), "a long, b long"), "more")
            merged = table(components(more).toDF("part", "least"), "merged")
            loose = loose.join(merged, "part", "left").select("rep", F.coalesce("least", "part").alias("part"))
        whole = whole.union(loose.select("rep", "part"))
    whole = table(whole, "whole")

    ends = classes.select("n", "sig_a", "sig_b", "rep").join(whole, "rep", "left")
    ends = table(ends.select("n", "sig_a", "sig_b", F.coalesce("part", "rep").alias("component_id")), "ends")
    out = signed.select("doc_id", "n", "sig_a", "sig_b").join(ends, ["n", "sig_a", "sig_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that a smaller id's group covers; rows with a null id and without words all stay."""
    gone = near_duplicates(docs, doc_id, text).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")
