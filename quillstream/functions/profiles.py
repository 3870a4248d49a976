"""Expressions over profiles (arrays of numbers) and masks (arrays of booleans)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from .binding import let


def _places(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def runs(mask: Column) -> Column:
    """Intervals (s, e) of consecutive true entries, e exclusive."""
    def of(m: Column) -> Column:
        on = lambda i: F.coalesce(F.get(m, i), F.lit(False))
        starts = F.filter(_places(m), lambda i: on(i) & ~F.when(i > 0, on(i - 1)).otherwise(False))
        ends = F.filter(_places(m), lambda i: on(i) & ~on(i + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

    return let(mask, of)


def gap(n: Column) -> Column:
    """The widest gap that still joins two bands of a profile of n entries."""
    return F.greatest(F.lit(2), F.bround(n * 0.008).cast("int"))


def merge_gaps(bands: Column, most: Column) -> Column:
    """Bands whose gap to the one before is at most ``most`` are joined to it."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(b["s"] - last["e"] <= most, F.lit(False))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), b["e"].alias("e"))))
        return F.when(near, joined).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(bands, none, step)


def mean(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)


def deviation(p: Column) -> Column:
    """The population's standard deviation."""
    return let(mean(p), lambda m: F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(p)))


def quantile(p: Column, q: float) -> Column:
    """With linear interpolation."""
    at = (F.size(p) - 1) * F.lit(q)
    low = F.floor(at).cast("int")

    def of(s: Column) -> Column:
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(p) - 1))
        return a + (b - a) * (at - low)

    return let(F.array_sort(p), of)


def lower_median(p: Column) -> Column:
    """The smaller of the two middle values, as is; quantile(p, 0.5) is their mean."""
    return let(F.array_sort(p), lambda s: F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")))


def band_score(p: Column) -> Column:
    """(score, bands, gap_fraction) of a profile; -10 for an empty one."""
    widest = F.greatest(F.lit(3), F.floor(F.size(p) / 5).cast("int"))

    def of(k: Column) -> Column:
        m, level = k["m"], F.greatest(k["m"] * 0.75, k["q"] * 0.70)
        bands = let(level, lambda v: F.size(F.filter(runs(F.transform(p, lambda x: x > v)), lambda r: r["e"] - r["s"] <= widest)))
        gaps = let(m * 0.45, lambda v: F.size(F.filter(p, lambda x: x < v)) / F.size(p))
        empty = (m <= 1e-6) | (F.array_max(p) <= 1e-6)
        full = let(F.struct(bands.alias("b"), gaps.alias("g")), lambda z: F.struct((F.log1p(F.greatest(F.lit(1), z["b"])) + 1.25 * k["d"] / (m + 1e-6) + 0.75 * z["g"]).alias("score"), z["b"].cast("long").alias("bands"), z["g"].alias("gap_fraction")))
        none = F.struct(F.lit(-10.0).alias("score"), F.lit(0).cast("long").alias("bands"), F.lit(0.0).alias("gap_fraction"))
        return F.when(empty, none).otherwise(full)

    return let(F.struct(mean(p).alias("m"), quantile(p, 0.65).alias("q"), deviation(p).alias("d")), of)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing with a width of a 500th of the profile, 1 at least, mirrored at the ends."""
    v = np.asarray(values, float)
    if len(v) < 2:
        return v
    sigma = max(1.0, len(v) / 500)
    r = min(int(4 * sigma + 0.5), len(v) - 1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(v, r, mode="reflect"), k / k.sum(), mode="valid")


def intervals(mask: np.ndarray) -> np.ndarray:
    """Rows (start, end) of consecutive true entries, as runs() has them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]])))
    return edge.reshape(-1, 2)


@pandas_udf(ArrayType(DoubleType()))
def smooth(profiles: pd.Series) -> pd.Series:
    """smoothed() of each profile (an Arrow UDF)."""
    return profiles.map(smoothed)
