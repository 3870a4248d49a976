"""Layouts: priors learned per item, and the decision table that uses them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import profiles as p
from ..functions.binding import let

#: Fixed values of the decision table.
CONFIDENT, AGREED, SAFE_180, FULL = 0.40, 0.70, 0.90, 0.50
SUPPORT_PAGES, SUPPORT_SHARE, ELIGIBLE_SHARE = 5, 0.80, 0.25
CONFLICT, MARGIN = 0.65, 0.15
SEPARATOR = 28


def opposed(left: Column, right: Column) -> Column:
    return ((left == 90) & (right == 270)) | ((left == 270) & (right == 90))


def item_priors(pages: DataFrame) -> DataFrame:
    """The pair of opposed angles that an item's pages mostly have, where it is well supported.

    ``pages``: item, page, pos, left_angle, right_angle, left_content, right_content, left_conf,
    right_conf. Of an item's rows for one page the first counts. Equal counts go to the larger pair.
    """
    first = F.row_number().over(Window.partitionBy("item", "page").orderBy("pos")) == 1
    p = pages.where(F.coalesce(F.col("item"), F.lit("")) != "").withColumn("_f", first).where("_f and left_content and right_content")
    conf = F.least("left_conf", "right_conf")
    strong = opposed(F.col("left_angle"), F.col("right_angle")) & (conf >= CONFIDENT)
    counted = p.groupBy("item", "left_angle", "right_angle").agg(F.count("*").alias("eligible"), F.count_if(strong).alias("n"), F.min(F.when(strong, conf)).alias("low"))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", "left_angle", "right_angle", "low"))).alias("b")
    g = counted.groupBy("item").agg(F.sum("eligible").alias("eligible_pages"), F.sum("n").alias("opposed_pages"), best)
    enough = (F.col("b.n") >= SUPPORT_PAGES) & (F.col("b.n") / F.col("opposed_pages") >= SUPPORT_SHARE) & (F.col("b.n") / F.col("eligible_pages") >= ELIGIBLE_SHARE)
    return g.where(enough).select(
        "item", F.col("b.left_angle").alias("prior_left"), F.col("b.right_angle").alias("prior_right"), F.col("b.n").alias("supporting_pages"),
        "opposed_pages", "eligible_pages", F.col("b.low").alias("minimum_confidence"),
    )


def decide(r: DataFrame) -> DataFrame:
    """Add ``transform``: the first line of the decision table that holds.

    ``r``: gutter (boolean), wide, mixed, full_angle, full_conf, and per side left_/right_ angle,
    conf, content; prior_left and prior_right, null without a prior.
    """
    c = F.col
    la, ra, lc, rc, lm, rm = (c(x) for x in ("left_angle", "right_angle", "left_conf", "right_conf", "left_content", "right_content"))
    both, low = lm & rm, F.least(lc, rc)
    sides = [(lm, la, lc, c("prior_left")), (rm, ra, rc, c("prior_right"))]

    def total(agree: bool) -> Column:
        return sum((F.when(m & ((a == p) if agree else (a != p)) & (k >= CONFIDENT), k).otherwise(0.0) for m, a, k, p in sides), F.lit(0.0))

    support, conflict = total(True), total(False)
    strong = (conflict >= CONFLICT) & (conflict > support + MARGIN)
    compatible = (lm & (la == c("prior_left")) & (lc >= CONFIDENT)) | (rm & (ra == c("prior_right")) & (rc >= CONFIDENT))
    backed = ((c("full_angle") == c("prior_left")) | (c("full_angle") == c("prior_right"))) & (c("full_conf") >= FULL)
    g, full = c("gutter"), c("full_angle")
    agreed = g & both & (la == ra) & (low >= AGREED)
    prior = g & c("prior_left").isNotNull() & (lm | rm)
    needed = F.when(full == 180, SAFE_180).otherwise(FULL)
    out = (
        F.when(g & opposed(la, ra) & both & (low >= CONFIDENT), "split_opposed_regions_then_vertical_reading_order")
        .when(agreed & (la == 180) & (low < SAFE_180), "unchanged_unsafe_180")
        .when(agreed & (la == 0), "unchanged_region_agreement")
        .when(agreed, "region_agreed_whole_page_rotation")
        .when(prior & ~strong & (compatible | backed), "item_prior_opposed_regions_then_vertical_reading_order")
        .when(prior, "unchanged_item_prior_conflict")
        .when(g & (lm != rm), "unchanged_single_region_uncertain")
        .when(g, "unchanged_conflicting_wide_layout")
        .when(c("wide"), "unchanged_unvalidated_wide_partition")
        .when((full != 0) & c("mixed"), "unchanged_mixed_nonwide_layout")
        .when((full != 0) & (c("full_conf") >= needed), "whole_page_rotation")
        .when(full != 0, "unchanged_low_confidence")
        .otherwise("unchanged")
    )
    return r.withColumn("transform", out)


def generation_limits(meaningful: Column, luminance: Column, bright: Column) -> Column:
    """(tokens, retries, reason) that bound blank and dark pages; null for others."""
    limit = lambda n, why: F.struct(F.lit(n).cast("long").alias("tokens"), F.lit(0).cast("long").alias("retries"), F.lit(why).alias("reason"))
    dark = (F.coalesce(luminance, F.lit(255.0)) < 60) & (F.coalesce(bright, F.lit(1.0)) >= 0.10) & (F.coalesce(bright, F.lit(1.0)) < 0.65)
    return F.when(~F.coalesce(meaningful, F.lit(False)), limit(128, "low_visual_content_region")).when(dark, limit(384, "dark_mount_with_local_light_content"))


def stack(regions: DataFrame, page: str, order: str, width: str, height: str) -> DataFrame:
    """Places (x0, y0, x1, y1) of regions put under one another, centred, with a gap between."""
    w = Window.partitionBy(page)
    above = F.coalesce(F.sum(F.col(height) + SEPARATOR).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = F.floor((F.max(width).over(w) - F.col(width)) / 2)
    return regions.select(page, order, x.alias("x0"), above.alias("y0"), (x + F.col(width)).alias("x1"), (above + F.col(height)).alias("y1"))


#: Fixed values of the gutter: where it is looked for, the parts beside it, the quantiles, and what makes it valid.
SEARCH, OUTER, LOW_SHARE = (0.32, 0.68), ((0.05, 0.28), (0.72, 0.95)), 0.25
REFERENCE_LEAST, DEPTH_MOST, WIDTH_LEAST = 0.005, 0.25, 0.02


def gutter_evidence(profile: Column, width: Column) -> Column:
    """Where a wide image parts in two, from its (smoothed) share of edges per column of pixels; ``width``
    in pixels of the image. A struct of x, run_left, run_right, valid, minimum, reference, central_low, depth, share.

    The middle part is searched for runs of columns with at most a quarter of what the parts beside it
    have; the widest run counts, of equally wide ones the most central, then the first; without one,
    the lowest column.
    """
    at = lambda n, share: F.bround(n * F.lit(share)).cast("int")
    none = F.array().cast("array<double>")

    def measured(v: Column) -> Column:
        n = F.size(v)
        left, right = at(n, SEARCH[0]), at(n, SEARCH[1])
        part = lambda a, b: F.slice(v, a + 1, F.greatest(b - a, F.lit(0)))
        outer = F.concat(*(part(at(n, a), at(n, b)) for a, b in OUTER))
        return F.struct(v.alias("v"), left.alias("left"), F.coalesce(part(left, right), none).alias("c"), F.when(F.size(outer) > 0, p.quantile(outer, 0.5)).otherwise(0.0).alias("ref"))

    def placed(m: Column) -> Column:
        n, low = F.size(m["v"]), p.runs(F.transform(m["c"], lambda x: x <= m["ref"] * LOW_SHARE))
        off = lambda r: F.abs(m["left"] + (r["s"] + r["e"]) / 2 - n / 2)
        rank = lambda r: F.struct((r["e"] - r["s"]).alias("w"), (-off(r)).alias("o"), (-r["s"]).alias("f"), r["s"].alias("s"), r["e"].alias("e"))
        best = F.array_max(F.transform(low, rank))
        bottom = (F.array_position(m["c"], F.array_min(m["c"])) - 1).cast("int")
        ends = F.when(best.isNotNull(), F.struct((m["left"] + best["s"]).alias("a"), (m["left"] + best["e"]).alias("b"))).otherwise(F.struct((m["left"] + bottom).alias("a"), (m["left"] + bottom + 1).alias("b")))
        return F.struct(*(m[k].alias(k) for k in ("v", "c", "ref")), ends["a"].alias("a"), ends["b"].alias("b"), best.isNotNull().alias("run"))

    def result(m: Column) -> Column:
        n = F.size(m["v"])
        at_ = F.when(m["run"], F.floor((m["a"] + m["b"]) / 2)).otherwise(m["a"]).cast("int")
        low = F.when(F.size(m["c"]) > 0, p.quantile(m["c"], 0.2)).otherwise(m["ref"])
        depth, share = low / F.greatest(m["ref"], F.lit(1e-6)), (m["b"] - m["a"]) / F.greatest(n, F.lit(1))
        pixel = lambda k: F.bround(k * width / n).cast("long")
        return F.struct(
            pixel(at_).alias("x"), pixel(m["a"]).alias("run_left"), pixel(m["b"]).alias("run_right"),
            ((m["ref"] >= REFERENCE_LEAST) & (depth <= DEPTH_MOST) & (share >= WIDTH_LEAST)).alias("valid"), F.get(m["v"], at_).alias("minimum"),
            m["ref"].alias("reference"), low.alias("central_low"), depth.alias("depth"), share.alias("share"),
        )

    return let(let(let(profile, measured), placed), result)


#: Fixed values of content: least share of ink, luminance and light that paper has, least spread.
INK_LEAST, LUMINANCE_LEAST, LIGHT_LEAST, SPREAD_LEAST = 0.002, 80.0, 0.18, 12.0


def content_metrics(gray: Column, ink_fraction: Column) -> Column:
    """Of a region's grey values (array) and share of ink: median luminance, shares of light pixels, two
    quantiles, and whether it looks like paper that carries marks."""
    share = lambda g, least: F.size(F.filter(g, lambda x: x >= least)) / F.size(g)

    def of(g: Column) -> Column:
        m = F.struct(p.quantile(g, 0.5).alias("mid"), share(g, 160).alias("b160"), share(g, 200).alias("b200"), p.quantile(g, 0.05).alias("low"), p.quantile(g, 0.95).alias("high"))
        meaningful = lambda v: (ink_fraction >= INK_LEAST) & ((v["mid"] >= LUMINANCE_LEAST) | (v["b160"] >= LIGHT_LEAST)) & (v["high"] - v["low"] >= SPREAD_LEAST)
        return let(m, lambda v: F.struct(
            ink_fraction.alias("ink_fraction"), v["mid"].alias("median_luminance"), v["b160"].alias("bright_fraction_160"), v["b200"].alias("bright_fraction_200"),
            v["low"].alias("luminance_p05"), v["high"].alias("luminance_p95"), meaningful(v).alias("meaningful_content"),
        ))

    return let(gray, of)


#: Fixed values of orientation: least difference of the axes in a tile; weights; what is sparse, ambiguous, wide or tall.
VOTE_MARGIN, SPARSE, AXIS_LEAST, DIRECTION_LEAST, DIRECTION_FULL = 0.12, 0.002, 0.035, 0.12, 0.045
WIDE_FROM, TALL_FROM, SPREAD_FROM = 1.45, 2.3, 1.35


def _score(profile: np.ndarray) -> tuple[float, int, float]:
    """band_score() of a smoothed profile, for tiles of one image."""
    v = p.smoothed(profile)
    mean = v.mean() if len(v) else 0.0
    if mean <= 1e-6 or v.max() <= 1e-6:
        return -10.0, 0, 0.0
    bands = p.intervals(v > max(0.75 * mean, 0.70 * np.quantile(v, 0.65)))
    fits = int((bands[:, 1] - bands[:, 0] <= max(3, len(v) // 5)).sum())
    gaps = float((v < 0.45 * mean).mean())
    return math.log1p(max(1, fits)) + 1.25 * float(v.std()) / (mean + 1e-6) + 0.75 * gaps, fits, gaps


def _upright(ink: np.ndarray) -> tuple[float, int]:
    """How far the lines' weight lies below their middle, and the number of lines that tell.

    All bands are measured at once: running sums over the rows give each band's ink and its centre.
    """
    rows = ink.sum(axis=1, dtype=float)
    v = p.smoothed(rows / ink.shape[1])
    if v.max() <= 1e-6:
        return 0.0, 0
    bands = p.intervals(v > 0.65 * max(v.mean(), np.quantile(v, 0.58)))
    apart = bands[1:, 0] - bands[:-1, 1] > max(2, round(0.008 * len(v)))
    start, end = bands[np.append(True, apart), 0], bands[np.append(apart, True), 1]
    height, total = end - start, np.add.reduceat(np.append(rows, 0.0), np.stack([start, end], 1).ravel())[::2]
    fits = (height >= 4) & (height <= max(12, round(0.22 * len(rows)))) & (total >= 20)
    if not fits.any():
        return 0.0, 0
    tilt = []
    for a, b, whole in zip(start[fits], end[fits], total[fits], strict=True):
        place = (np.arange(b - a) + 0.5) / (b - a) - 0.5
        tilt.append(0.65 * (rows[a:b] @ place) / whole + 0.35 * place[int(np.argmax(p.smoothed(rows[a:b])))])
    return float(np.average(tilt, weights=np.minimum(total[fits], 2000.0))), int(fits.sum())


def _votes(ink: np.ndarray) -> list[int]:
    """For each half of the image (left, right, upper, lower) whose axes differ: 0 if lines run across, 90 if down."""
    h, w = ink.shape
    halves = [ink[:, : w // 2], ink[:, w // 2 :], ink[: h // 2], ink[h // 2 :]]
    margins = [_score(x.mean(axis=1))[0] - _score(x.mean(axis=0))[0] for x in halves if x.size and x.mean() >= 0.001]
    return [0 if m > 0 else 90 for m in margins if abs(m) >= VOTE_MARGIN]


_I, _D = IntegerType(), DoubleType()
_SIDE = StructType([StructField("angle", _I), StructField("score", _D), StructField("bands", _I)])
ORIENTATION = StructType(
    [StructField("angle", _I), *(StructField(k, _D) for k in ("confidence", "axis_confidence", "direction_confidence", "across", "down"))]
    + [StructField("across_bands", _I), StructField("down_bands", _I), *(StructField(k, _D) for k in ("across_gaps", "down_gaps", "ink_fraction"))]
    + [StructField("votes", ArrayType(_I)), StructField("ambiguous", BooleanType()), StructField("flags", ArrayType(StringType())), StructField("upright", ArrayType(_SIDE))]
)


def analyzed(ink: np.ndarray, width: float, height: float) -> tuple:
    """The fields of ORIENTATION for one mask of ink; see orient()."""
    across, down = _score(ink.mean(axis=1)), _score(ink.mean(axis=0))
    margin, base = across[0] - down[0], 0 if across[0] >= down[0] else 90
    sides = [(a, *_upright(np.rot90(ink, a // 90))) for a in (base, base + 180)]
    sides.sort(key=lambda x: -x[1])
    axis = abs(margin) / max(0.25, abs(across[0]) + abs(down[0]))
    direction = min(1.0, (sides[0][1] - sides[1][1]) / DIRECTION_FULL)
    votes, share = _votes(ink), float(ink.mean())
    sparse, mixed = share < SPARSE, len(set(votes)) == 2
    ambiguous = sparse or mixed or axis < AXIS_LEAST or direction < DIRECTION_LEAST
    flags = {"sparse_or_blank": sparse, "mixed_orientation_regions": mixed, "wide_spread_or_landscape": width > WIDE_FROM * height, "tall_strip": height > TALL_FROM * width, "orientation_ambiguous": ambiguous}
    angle = 0 if sparse else sides[0][0]
    return (angle, min(1.0, 0.75 * axis + 0.25 * direction), axis, direction, across[0], down[0], across[1], down[1], across[2], down[2], share, votes, ambiguous, [k for k, on in flags.items() if on], [tuple(x) for x in sides])


def orient(pages: DataFrame, ink: str, width: str, height: str) -> DataFrame:
    """``pages`` with ``orientation``: of a mask of ink (array of rows of booleans or numbers) the angle that
    makes its lines run across and stand upright, how sure that is, and flags (Arrow batches, no shuffle).

    Lines make sharp bands in the profile of their axis; of both directions the one wins in which
    lines are heavier below their middle.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [analyzed(np.asarray([list(r) for r in m], dtype=float) > 0, w, h) for m, w, h in zip(part[ink], part[width], part[height], strict=True)]
            yield part.assign(orientation=[dict(zip(ORIENTATION.names, r, strict=True)) | {"upright": [dict(zip(_SIDE.names, x, strict=True)) for x in r[-1]]} for r in rows])

    return pages.mapInPandas(run, StructType([*pages.schema.fields, StructField("orientation", ORIENTATION)]))


def by_geometry(found: Column) -> Column:
    """(angle, transform) of the backend that rests on geometry alone: an ambiguous page stays as it is."""
    angle = F.when(found["ambiguous"], 0).otherwise(found["angle"])
    return F.struct(angle.alias("angle"), F.when(angle != 0, "whole_page_rotation").when(found["ambiguous"], "unchanged_geometry_ambiguous").otherwise("unchanged").alias("transform"))


def run_counters(decided: DataFrame) -> DataFrame:
    """One row of counts over decided pages (transform, ambiguous, flags, prior_applied, there) that must add
    up: processed and missing to rows, transformed and unchanged to processed (``reconciled``)."""
    there = F.coalesce("there", F.lit(True))
    changed = ~F.startswith("transform", F.lit("unchanged"))
    n = lambda c: F.count_if(there & F.coalesce(c, F.lit(False)))
    g = decided.agg(
        F.count("*").alias("row_count"), F.count_if(there).alias("processed"), F.count_if(~there).alias("missing"), n(changed).alias("transformed"), n(~changed).alias("unchanged"),
        n(F.col("ambiguous")).alias("ambiguous"), n(F.array_contains("flags", "mixed_orientation_regions")).alias("mixed"),
        n(F.contains("transform", F.lit("opposed_regions_then_vertical_reading_order"))).alias("split_opposed"), n(F.col("prior_applied")).alias("prior_applied"),
    )
    sums = (F.col("processed") + F.col("missing") == F.col("row_count")) & (F.col("transformed") + F.col("unchanged") == F.col("processed"))
    return g.withColumn("reconciled", sums)


def inspect(pages: DataFrame, gutter: Column, width: Column, height: Column) -> DataFrame:
    """First pass over pages: ``wide``, ``gutter`` (a valid one of a wide page, else null) and ``probes``, the
    boxes to look at: the whole page, and the sides of a gutter up to its blank part."""
    wide = width > SPREAD_FROM * height
    g = F.when(wide & gutter["valid"], gutter)
    box = lambda name, x0, x1: F.struct(F.lit(name).alias("region"), x0.cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), x1.cast("long").alias("x1"), height.cast("long").alias("y1"))
    whole = box("full", F.lit(0), width)
    sides = F.array(whole, box("left", F.lit(0), F.greatest(F.lit(1), g["run_left"])), box("right", F.least(width - 1, g["run_right"]), width))
    return pages.withColumns({"wide": wide, "gutter": g}).withColumn("probes", F.when(F.col("gutter").isNull(), F.array(whole)).otherwise(sides))
