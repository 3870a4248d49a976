"""Quality rules: learned decision lists over interpretable statistics of a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded, scope, scratch, slices, table, texts
from .wordhash import Hasher, inside, mix, words

#: The counts per document, all long.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARK, _STOP, _GAP = _class(b"!?"), _class(b".,;:"), _class(b"\t\n\v\f\r ")
_CHAR = (np.arange(256) & 0xC0) != 0x80  # a code point's first byte


def counts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> dict[str, np.ndarray]:
    """COUNTS of each text; ``data`` has their UTF-8 bytes, ``offsets`` the n + 1 bounds."""

    def per_text(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return np.diff(sums[bounds])

    start, end, bounds = words(data, offsets)
    n = np.diff(bounds)
    out = {"n_words": n}
    for name, kind in (("word_chars", _CHAR & ~_GAP), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_stops", _STOP)):
        out[name] = per_text(kind[data], offsets)
    repeated = np.zeros(len(start), bool)
    if len(start) >= 3:
        own = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(inside(bounds, 3))
        # A window counts within its text alone, so the text's number goes into its key.
        key = hasher.ngrams(hasher.spans(hasher.prefix(data), start, end), 3)[at] ^ mix(own[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    out["n_repeat_words"] = per_text(repeated, bounds)
    raw, lines, dups = data.tobytes(), [], []
    for i, j in zip(offsets.tolist(), offsets[1:].tolist()):
        full = [x for x in raw[i:j].split(b"\n") if x.strip(b"\t\n\v\f\r ")]
        lines.append(len(full))
        dups.append(len(full) - len(set(full)))
    return out | {"n_lines": np.asarray(lines, np.int64), "n_dup_lines": np.asarray(dups, np.int64)}


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and COUNTS of every whole text; null: none of anything. ``whole``: row, a struct of all columns, for doc_id."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(5)
        for part in slices(batches, "text"):
            c = counts(*texts(part), hasher)
            row = pa.StructArray.from_arrays(part.columns, names) if whole else part.column(0)
            yield pa.RecordBatch.from_arrays([row, *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], names=["row" if whole else "doc_id", *COUNTS])

    if whole:
        return docs.mapInArrow(run, StructType([StructField("row", docs.schema), *(StructField(c, LongType()) for c in COUNTS)]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: Ratios that rules may use, as (name, numerator, denominator).
RATIOS = [
    ("word_length", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"), ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "n_words"), ("stops", "n_stops", "n_words"), ("line_words", "n_words", "n_lines"),
]


def features() -> list[Column]:
    return [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(name) for name, a, b in RATIOS] + [F.col("n_words").cast("double").alias("words")]


NAMES = [r[0] for r in RATIOS] + ["words"]
Rule = list[tuple[int, bool, float]]  # (feature, at least or else at most, threshold)


def _covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, least, t in rule:
        out &= x[:, j] >= t if least else x[:, j] <= t
    return out


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_terms: int = 4, precision: float = 0.8, seed: int = 0) -> list[Rule]:
    """Sequential covering: rules for bad rows, in the order in which they were found.

    Each rule grows on two thirds of the rows that no rule covers yet, term by term by information
    gain, and is pruned from its end on the other third as long as (hits - misses) / covered does
    not fall. A rule must keep ``precision`` on both parts, else the search ends.
    """
    rules, left = [], np.arange(len(x))
    rng = np.random.default_rng(seed)
    while len(rules) < max_rules and bad[left].sum() >= 8:
        part = rng.permutation(left)
        grow, prune = part[: len(part) * 2 // 3], part[len(part) * 2 // 3 :]
        rule, now = [], grow
        while len(rule) < max_terms and bad[now].any() and not bad[now].all():
            p, n = bad[now].sum(), len(now)
            best = (1e-9, None)
            for j in range(x.shape[1]):
                order = np.argsort(x[now, j], kind="stable")
                v, b = x[now, j][order], bad[now][order].astype(float)
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                hits = np.cumsum(b)[cut]
                for least, h, c in ((False, hits, cut + 1.0), (True, p - hits, n - cut - 1.0)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(h >= 3, h * (np.log2(h / c) - np.log2(p / n)), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (j, least, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
            if best[1] is None:
                break
            rule.append(best[1])
            now = now[_covers(x[now], rule[-1:])]

        def worth(r: Rule) -> float:
            c = _covers(x[prune], r)
            return (2 * bad[prune][c].sum() - c.sum()) / max(1, c.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        c, g = _covers(x[prune], rule), _covers(x[grow], rule)
        if not rule or bad[grow][g].mean() < precision or not c.any() or bad[prune][c].mean() < precision:
            break
        rules.append(rule)
        left = left[~_covers(x[left], rule)]
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false at the first rule that holds, true if none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        terms = [F.col(NAMES[j]) >= F.lit(t) if least else F.col(NAMES[j]) <= F.lit(t) for j, least, t in rule]
        out = F.when(reduce(lambda a, b: a & b, terms), F.lit(False)).otherwise(out)
    return out


def marked(labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id and quality of at most ``max_labelled`` labelled documents, chosen by hash; that bound makes
    their broadcast safe. A document with several labels counts as bad if one says so; null labels are left out."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return F.broadcast(bounded(known, "doc_id", max_labelled))


def fit(stats: DataFrame, known: DataFrame) -> list[Rule]:
    """Rules from the rows of ``stats`` whose id ``known`` has (see marked()); of rows that share an id one
    is taken, the one with the least counts, so the ids bound what reaches the driver."""
    one = stats.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "quality", "c.*")
    rows = one.select(*features(), "quality", "doc_id").toPandas().sort_values(["doc_id", *NAMES])
    return learn(rows[NAMES].to_numpy(float), rows["quality"].to_numpy() == 0)


BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every row of ``docs``.

    Defined cases: a null or empty text has no words and fails the base; repeated rows are judged
    alike; without labels, or without bad ones, the list is empty and the base alone decides; an
    empty table gives no rows; only doc_id and text are read, so further columns may have any name. No shuffle of texts: one pass gives the counts, the rest is
    conditional expressions over them.
    """
    stats = scratch(statistics(docs))
    rules = fit(stats, marked(labels, max_labelled))
    f = stats.select("*", *features()).withColumn("base_failed", F.expr(BASE))
    return f.withColumn("kept", ~F.col("base_failed") & expression(rules)).select("doc_id", *COUNTS, "base_failed", "kept")


def retain(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns. Each row is judged by its own
    text, whatever its id; only labelled documents' counts are gathered for the fit, and nothing is joined
    after it. Defined cases as in judge(); columns may have any name, as they stay within a struct."""
    known = marked(labels, max_labelled)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known.select("doc_id"), "doc_id", "left_semi")
    with scope():
        rules = fit(scratch(statistics(labelled)), known)
    f = statistics(docs, whole=True).select("*", *features())
    return f.where(~F.expr(BASE) & expression(rules)).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
