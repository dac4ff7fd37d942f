"""Connected components by alternating large-star and small-star steps (Kiveris et al.), on DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table


#: Links that one task contracts: 16 MB of node pairs.
EDGES_PER_TASK = 1_000_000


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links (a, b) as stars around the least node of each of its parts; more than EDGES_PER_TASK are contracted that many at a time."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if size and size + batch.num_rows > EDGES_PER_TASK:
            yield _stars(got)
            got, size = [], 0
        if batch.num_rows:
            got.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
    if got:
        yield _stars(got)


def _stars(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*links))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.record_batch({"a": nodes[far], "b": nodes[label[far]]})


def _contract(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contracted, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node it is linked with, itself included.

    Self-links and repeated links are allowed, rows with a null end are not
    used, and no edges give no rows. Partitions are contracted to stars, then
    dealt out again at EDGES_PER_TASK to a task and contracted once more; where
    one task was enough, that is the result. Larger graphs go on with star steps.
    Every step's minima are written before they are joined back, so a hub's rows
    are summed before they are shuffled and both sides of each join are exchanges
    whose hot partitions AQE can split.
    """
    stars = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().filter("a <> b")
    e = table(_contract(stars), "edges")
    tasks = -(-e.count() // EDGES_PER_TASK)
    e = table(_contract(e.coalesce(max(1, tasks))), "edges")
    before = _state(e)
    while before[0] and tasks > 1:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = table(large, "large")
        least = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = table(least.select("a", F.col("m").alias("b")).union(small).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b")).distinct()
