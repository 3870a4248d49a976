"""Connected components of a graph of pairs, on the executors throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, scratch

#: A graph of so many edges is settled in one task, in some 100 MB; a larger one in rounds.
SMALL = 1 << 20


def settled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and the smallest id that each reaches: roots are hung on smaller ones, then paths are cut short."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, root = at[: len(x)], at[len(x) :], np.arange(len(ids))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low < high
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _in_one(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate([np.asarray(c) for c in z]) for z in zip(*([b.column(0), b.column(1)] for b in batches), strict=True)]
        if cols:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in settled(*cols)], names=["id", "comp"])

    return scratch(e.coalesce(1).mapInArrow(run, "id long, comp long"))


def components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(id, comp): the smallest id that each id of ``edges`` (x, y) reaches.

    Up to ``small`` edges one task settles them. Beyond: alternating star steps; each node's larger
    neighbours, then its smaller ones, are hung on the smallest node of its neighbourhood, until
    every node hangs on its component's smallest. Rows never exceed the edges, no neighbourhood is
    gathered in one place (minima are aggregated before the shuffle and joined back), and the rounds
    go with the logarithm of a component's diameter.
    """
    e = scratch(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    if e.count() <= small:
        return _in_one(e)
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, e = e, scratch(small)
        free(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        before = now
    raise RuntimeError("components did not settle")
