"""Toxicity: a counterfactual-regularised classifier.

A linear model over the presence of words and word beginnings is fitted to labelled documents. For
each labelled document with an identity term a second version is made in which such terms are
swapped for others of their group, and the training loss has a penalty on the change of the score,
so that naming a group tells nothing by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keyed, scratch, slices, table, texts, unkeyed
from .wordhash import Hasher, mix

#: Groups of identity terms, lower case; a term is swapped for others of its group.
IDENTITY = [
    ["women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"],
    ["muslim", "muslims", "christian", "christians", "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "atheist", "atheists", "catholic", "sikh"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"],
    ["immigrants", "refugees", "foreigners", "migrants", "natives"],
    ["disabled", "deaf", "blind", "autistic", "elderly", "young", "old"],
    ["frauen", "männer", "muslime", "christen", "juden", "ausländer", "schwarze", "weiße", "schwule", "lesben"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "noirs", "blancs", "homosexuels"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "negros", "blancos", "homosexuales"],
]
#: Features: the whole word, and its first 4, 5 and 6 bytes where it is longer.
HEADS = (0, 4, 5, 6)
BITS = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SALT = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(4)]


def tokens(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (one row per run of letters, one column per entry of HEADS; -1: none), and
    the n + 1 bounds of the texts in the rows."""
    on = _LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = on[:-1], on[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    sums = hasher.prefix(data)
    out = np.full((len(start), len(HEADS)), -1, np.int32)
    for j, head in enumerate(HEADS):
        rows = slice(None) if not head else np.flatnonzero(end - start > head)
        stop = end if not head else start[rows] + head
        value = mix(hasher.spans(sums, start[rows], stop) ^ _SALT[j])
        out[rows, j] = (value >> np.uint64(64 - BITS)).astype(np.int32)
    return out, np.searchsorted(start, offsets)


def _hasher() -> Hasher:
    return Hasher(10, lower=True)


def identity_rows() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per identity term: its features, its group and the features of the term it is swapped for."""
    raw = [t.encode() for g in IDENTITY for t in g]
    f, _ = tokens(np.frombuffer(b" ".join(raw), np.uint8), np.asarray([0, len(b" ".join(raw))]), _hasher())
    group, nxt, at = [], [], 0
    for k, g in enumerate(IDENTITY):
        group += [k] * len(g)
        nxt += [at + (i + 1) % len(g) for i in range(len(g))]
        at += len(g)
    return f, np.asarray(group), f[nxt]


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` labelled rows that aren't held out, chosen by hash.

    That bound is what makes the broadcast of their ids safe. A document with several labels counts
    as toxic if one says so; of rows that share a labelled id one is taken, with the smallest text.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = bounded(known, "doc_id", most)
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def example_features(rows: DataFrame) -> DataFrame:
    """Per labelled document: toxic, its distinct features, and those of its swapped version (empty
    if it has no identity term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (own, _, other) = _hasher(), identity_rows()
        place = {int(w): i for i, w in enumerate(own[:, 0])}
        known = np.asarray(sorted(place), np.int32)
        for part in slices(batches, "text"):
            f, bounds = tokens(*texts(part), hasher)
            plain, swapped = [], []
            for i, j in zip(bounds, bounds[1:]):
                t = f[i:j]
                plain.append(np.unique(t[t >= 0]))
                hit = np.flatnonzero(np.isin(t[:, 0], known))
                if len(hit):
                    t = t.copy()
                    t[hit] = other[[place[int(w)] for w in t[hit, 0]]]
                    swapped.append(np.unique(t[t >= 0]))
                else:
                    swapped.append(np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(plain, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], names=["doc_id", "toxic", "f", "s"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, f array<int>, s array<int>")


class Model:
    """Weights of the chosen features; the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias

    def dense(self) -> np.ndarray:
        """For each feature its place among the chosen, or -1."""
        out = np.full(1 << BITS, -1, np.int32)
        out[self.features] = np.arange(len(self.features))
        return out


def chosen(counts: DataFrame, toxic: int, clean: int, most: int) -> np.ndarray:
    """The features whose presence tells most, by the G statistic; ``most`` rows reach the driver."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = F.lit(float(toxic + clean))

    def part(x: Column, row: Column, col: float) -> Column:
        return F.when(x > 0, x * F.log(x * n / (row * F.lit(col)))).otherwise(0.0)

    g = part(a, a + b, float(toxic)) + part(b, a + b, float(clean))
    best = counts.where("a + b >= 3").withColumn("g", g).orderBy(F.desc("g"), "k").limit(most)
    return np.asarray(sorted(r.k for r in best.select("k").collect()), np.int64)


def train(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, srows: np.ndarray, scols: np.ndarray, pairs: np.ndarray, m: int, l2: float, swap: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on sparse 0/1 rows.

    ``pairs`` are the rows that have a swapped version, ``srows``/``scols`` the entries of those
    versions; the loss has ``swap`` times the mean squared change of their linear score.
    """
    n = len(y)
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    has = np.zeros(n, bool)
    has[pairs] = True
    both = has[rows]
    m1, m2, mb1, mb2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, steps + 1):
        score = np.bincount(rows, w[cols], n) + b
        r = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / n
        g = np.bincount(cols, r[rows], m) + l2 * w
        if len(pairs):
            d = np.bincount(rows[both], w[cols[both]], n) - np.bincount(srows, w[scols], n)
            d *= 2 * swap / len(pairs)
            g += np.bincount(cols[both], d[rows[both]], m) - np.bincount(scols, d[srows], m)
        gb = r.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
        w -= rate * m1 / (np.sqrt(m2) + 1e-9)
        b -= rate * mb1 / (np.sqrt(mb2) + 1e-9)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000, max_features: int = 2048, l2: float = 2e-5, swap: float = 1.0, steps: int = 400) -> Model:
    """Fit on at most ``max_labelled`` documents; identity terms are features whatever their counts."""
    ex = scratch(example_features(labelled(docs, labels, max_labelled)))
    toxic = ex.where("toxic = 1").count()
    clean = ex.count() - toxic
    terms, _, other = identity_rows()
    forced = np.unique(np.concatenate([terms[:, 0], other[:, 0]]))
    if not toxic or not clean:
        return Model(forced, np.zeros(len(forced)), -3.0 if clean or not toxic else 3.0)
    per = ex.select("toxic", F.explode("f").alias("k")).groupBy("k").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    features = np.union1d(chosen(per, toxic, clean, max_features), forced)
    keep = F.array(*map(F.lit, features.tolist())).cast("array<int>")
    small = ex.select("doc_id", "toxic", F.array_intersect("f", keep).alias("f"), (F.size("s") > 0).alias("has"), F.array_intersect("s", keep).alias("s"))
    # At most max_labelled rows with a few features each.
    t = small.toArrow().sort_by("doc_id")
    place = {int(k): i for i, k in enumerate(features)}

    def entries(name: str) -> tuple[np.ndarray, np.ndarray]:
        col = t.column(name).combine_chunks()
        rows = np.repeat(np.arange(len(col)), np.asarray(pc.list_value_length(col)))
        return rows, np.asarray([place[k] for k in col.flatten().to_pylist()], np.int64)

    y = np.asarray(t.column("toxic")).astype(float)
    (rows, cols), (srows, scols) = entries("f"), entries("s")
    w, b = train(y, rows, cols, srows, scols, np.flatnonzero(np.asarray(t.column("has"))), len(features), l2, swap, steps)
    return Model(features, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text. The model is of bounded size: BITS and max_features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dense = _hasher(), model.dense()
        m = len(model.features)
        for part in slices(batches, "text"):
            f, bounds = tokens(*texts(part), hasher)
            at = np.where(f >= 0, dense[f], -1)
            row, col = np.nonzero(at >= 0)
            own = np.searchsorted(bounds, row, side="right") - 1
            cells = np.unique(own * m + at[row, col])
            s = np.bincount(cells // m, model.weights[cells % m], part.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=["doc_id", "score"])

    return unkeyed(keyed(docs).mapInArrow(run, "doc_id long, score double"))


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Defined cases: null and empty texts have the score of the bias alone; repeated rows score
    alike; labels without a document, null labels and held-out ones are not learned from; without
    toxic labels every score is low. Only doc_id (for the join with labels) and text are read.
    """
    s = score(docs, fit(docs, labels, max_labelled))
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def crc_held_out(doc_id: int) -> bool:
    """What held_out() computes."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
