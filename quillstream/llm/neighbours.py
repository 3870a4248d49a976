"""Approximate nearest neighbours: an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. A query takes
cells in order of the summed nearness of its halves to the two centroids, with a heap, until the
cells hold enough vectors; those are ranked again by the exact measure on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scope, scratch, table
from .wordhash import mix


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: of the usual length, finite, not zero."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    v = rows.select(F.col("vec_id").cast("long"), e.cast("array<float>")).where("vec_id is not null").where(fine)
    usual = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("embedding") == (usual.n if usual else 0))


def matrix(col: pa.Array) -> np.ndarray:
    """One row per vector; a zero is added to single numbers, so that there are two halves."""
    x = np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 2), np.float32)
    return x if x.shape[1] > 1 else np.hstack([x, np.zeros((len(x), 1), x.dtype)])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The closest centroid of each row, in steps that bound the memory."""
    norm = (c * c).sum(1)
    return np.concatenate([np.argmin(norm - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        for j in np.flatnonzero(n == 0):
            c[j] = x[rng.integers(len(x))]
    return c


class Index:
    """Centroids of both halves and the number of vectors in each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        self.count = np.zeros((len(first), len(second)), np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return nearest(x[:, :h], self.first), nearest(x[:, h:], self.second)

    def share(self, x: np.ndarray, k: int, recall: float, asked: int = 200) -> float:
        """The part of all vectors that the first cells must hold so that ``recall`` of the ``k`` nearest lie there.

        Measured on the sample ``x``, of which ``asked`` rows are the queries. The nearest among
        more vectors are nearer still, so on all of them this is on the safe side.
        """
        h, (i, j) = self.first.shape[1], self.cells(x)
        if len(x) <= k + 1:
            return 1.0
        need = []
        for at in np.unique(np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)):
            score = x @ x[at]
            score[at] = -np.inf
            cell = (self.first @ x[at, :h])[i] + (self.second @ x[at, h:])[j]
            best = np.sort(cell)
            need.append(1 - np.searchsorted(best, cell[np.argpartition(-score, k)[:k]]) / len(x))
        return float(np.quantile(np.concatenate(need), recall))

    def walk(self, q: np.ndarray, want: int) -> list[tuple[int, int]]:
        """Cells by summed nearness, nearest first, until they hold ``want`` vectors."""
        h = self.first.shape[1]
        a, b = self.first @ q[:h], self.second @ q[h:]
        ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        down, along, held = (-a[ia]).tolist(), (-b[ib]).tolist(), self.count[np.ix_(ia, ib)].tolist()
        # One entry a row: the next cell of a row replaces it, and a row's first cell brings the next row's.
        heap, out, got, ia, ib = [(down[0] + along[0], 0, 0)], [], 0, ia.tolist(), ib.tolist()
        while heap and got < want:
            _, i, j = heap[0]
            if n := held[i][j]:
                out.append((ia[i], ib[j]))
                got += n
            if j + 1 < len(along):
                heapq.heapreplace(heap, (down[i] + along[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(down):
                heapq.heappush(heap, (down[i + 1] + along[0], i + 1, 0))
        return out


def train(classes: DataFrame, n: int, centroids: int, sample: int) -> tuple[Index, np.ndarray]:
    """Codebooks from about ``sample`` vectors at most, chosen by hash, and these vectors."""
    part = classes
    if n > sample:
        # A fraction of 2^48 hashes: fine enough for any number of vectors; 5 % below, so that the bound holds.
        part = classes.where(F.pmod(F.xxhash64("c"), F.lit(1 << 48)) < int(0.95 * (1 << 48) * sample / n))
    x = matrix(part.select("c", "embedding").toArrow().sort_by("c").column("embedding").combine_chunks()).astype(np.float64)
    h = x.shape[1] // 2
    return Index(kmeans(x[:, :h], centroids, seed=4), kmeans(x[:, h:], centroids, seed=5)), x


def buckets(count: np.ndarray, block: int) -> tuple[list[int], list[int]]:
    """For each first centroid its first bucket and how many it has: small ones share one, large ones
    are split, so that a bucket has about ``block`` vectors."""
    first, parts, at, size = [], [], -1, block
    for c in count.sum(1).tolist():
        if c > block:
            parts.append(-(-c // block))
            first.append(at + 1)
            at, size = at + parts[-1], block
            continue
        if size + c > block:
            at, size = at + 1, 0
        first.append(at)
        parts.append(1)
        size += c
    return first, parts


def search(rows: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, sample: int = 20_000, block: int = 8192, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by inner product of each row whose id ``every`` divides.

    The codebooks grow with the square root of the number of vectors (1,024 centroids a half at
    most), so cells stay small. How many vectors are ranked again per query is measured: the share
    that ``recall`` of the nearest takes on the sample. Random directions without structure need a
    third or more; clustered data far less; a given ``share`` holds instead. Equal vectors are searched as one: only the k + 1
    smallest ids of such a class can be results, so a class that holds a third of all rows costs no
    more than another. Cells are stored in buckets of about ``block`` vectors, and queries meet them
    in groups of as many, so no task holds more than two blocks. Defined cases: null, zero,
    non-finite or odd-sized vectors take no part, nor do null ids; fewer candidates than k give all;
    ties go to the smaller id; an empty table gives no rows; rows that repeat an id and vector count
    as one; further columns of any name are left out.
    """
    with scope():
        found = _search(rows, every, k, recall, sample, block, share)
        return scratch(found, keep=True)


def _search(rows: DataFrame, every: int, k: int, recall: float, sample: int, block: int, share: float | None) -> DataFrame:
    spark = rows.sparkSession
    v = scratch(usable(rows).distinct())
    out_schema = "query_id long, rank int, vec_id long, score double"
    first = Window.partitionBy("embedding").orderBy("vec_id")
    ids = v.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = scratch(ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("c", F.element_at("ids", 1)))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], out_schema)
    index, known = train(classes, n, 1 << min(10, max(3, round(np.log2(n**0.5 / 3)))), sample)
    want = max(20 * k, int((index.share(known, k, recall) if share is None else share) * n))
    second = len(index.second)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = index.cells(matrix(b.column(1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=["c", "embedding", "i", "j"])

    placed = scratch(classes.select("c", "embedding").mapInArrow(assign, "c long, embedding array<float>, i int, j int"))
    for r in placed.groupBy("i", "j").count().collect():  # a row per cell: 2^20 at most
        index.count[r.i, r.j] = r["count"]
    start, parts = buckets(index.count, block)
    queries = v.where(F.col("vec_id") % every == 0)
    asked = scratch(queries.groupBy("embedding").agg(F.min("vec_id").alias("q")))
    n_asked = asked.count()
    groups = max(1, -(-n_asked // block))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, out = b.slice(lo, 256), []
                for q, e, x in zip(part.column(0).to_pylist(), part.column(1), matrix(part.column(1)).astype(np.float64), strict=True):
                    cells: dict[int, list[int]] = {}
                    for i, j in index.walk(x, want):
                        for s in range(start[i], start[i] + parts[i]):
                            cells.setdefault(s, []).append(i * second + j)
                    out += [(q, e.as_py(), s, c) for s, c in cells.items()]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["q", "qe", "s", "cells"])

    routed = asked.select("q", "embedding").repartition(max(1, -(-n_asked // 256)), "q").mapInArrow(route, "q long, qe array<float>, s int, cells array<int>")
    routed = routed.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, many = np.asarray(start), np.asarray(parts)
        for b in batches:
            c, e, i, j = (b.column(x) for x in range(4))
            i = np.asarray(i)
            s = begin[i] + (mix(np.asarray(c).view(np.uint64)) % many[i].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([c, e, pa.array((i * second + np.asarray(j)).astype(np.int32)), pa.array(s.astype(np.int32))], names=["c", "embedding", "cell", "s"])

    stored = placed.mapInArrow(store, "c long, embedding array<float>, cell int, s int")
    stored = stored.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rank(ask: pa.Table, have: pa.Table) -> pa.Table:
        q, c = np.asarray(ask.column("q")), np.asarray(have.column("c"))
        out: list[tuple] = []
        if len(q) and len(c):
            x = matrix(have.column("embedding").combine_chunks()).astype(np.float64)
            here, own = np.unique(np.asarray(have.column("cell")), return_inverse=True)
            qe = matrix(ask.column("qe").combine_chunks()).astype(np.float64)
            cells = ask.column("cells").combine_chunks()
            for lo in range(0, len(q), 128):
                part = slice(lo, lo + 128)
                score = qe[part] @ x.T
                mine = cells.slice(lo, 128)
                cell, row = np.asarray(mine.flatten()), np.repeat(np.arange(len(mine)), np.asarray(pc.list_value_length(mine)))
                at = np.minimum(np.searchsorted(here, cell), len(here) - 1)
                allowed = np.zeros((len(score), len(here)), bool)
                allowed[row[here[at] == cell], at[here[at] == cell]] = True
                score[~allowed[:, own]] = -np.inf
                m = min(k + 1, len(c))
                least = -np.partition(-score, m - 1, axis=1)[:, m - 1]
                row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                s = score[row, col]
                order = np.lexsort((c[col], -s, row))
                row, col, s = row[order], col[order], s[order]
                at = np.arange(len(row)) - np.searchsorted(row, row)
                keep = at <= k
                out.append((q[part][row[keep]], c[col[keep]], s[keep]))
        cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": cols[0], "c": cols[1], "score": cols[2]})

    best = routed.groupBy("s", "g").cogroup(stored.groupBy("s", "g")).applyInArrow(rank, "q long, c long, score double")
    near = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = best.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    # Classes become rows; among equal scores the ids decide.
    hits = best.select("q", "c", "score").join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    lists = hits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    # Each query of a class takes the class's list without itself.
    own = queries.join(asked, "embedding").select("q", F.col("vec_id").alias("query_id")).join(lists, "q")
    own = own.withColumn("hits", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
