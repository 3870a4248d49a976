"""Queries over profiles and layouts; embeddings stand for ink profiles, events for inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import profiles as p
from ..operators import layout
from .registry import query, table

c = F.col
_V = "with v as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as a, list_transform(embedding, lambda x: x > 0) as m from embeddings)"


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"), F.transform("embedding", lambda x: x > 0).alias("m"))


_RUNS = "r as (select *, list_filter(range(1, len(m) + 1), lambda i: m[i] and not (i > 1 and m[greatest(i - 1, 1)])) as s, list_filter(range(1, len(m) + 1), lambda i: m[i] and not (i < len(m) and m[least(i + 1, len(m))])) as e from v)"


@query(f"{_V}, {_RUNS} select vec_id, len(s)::bigint as n_runs, array_to_string(list_transform(range(1, len(s) + 1), lambda k: (s[k] - 1)::varchar || '-' || e[k]::varchar), ',') as runs from r")
def runs(spark: SparkSession, d: str) -> DataFrame:
    v = _profiles(spark, d).select("vec_id", p.runs(c("m")).alias("r"))
    return v.select("vec_id", F.size("r").cast("long").alias("n_runs"), F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("runs"))


@query(f"{_V}, {_RUNS}, g as (select *, list_filter(range(1, len(s) + 1), lambda k: k = 1 or s[k] - 1 - e[greatest(k - 1, 1)] > 2) as heads from r) select vec_id, array_to_string(list_transform(range(1, len(heads) + 1), lambda k: (s[heads[k]] - 1)::varchar || '-' || (case when k = len(heads) then e[len(e)] else e[heads[least(k + 1, len(heads))] - 1] end)::varchar), ',') as bands from g")
def gap_merge(spark: SparkSession, d: str) -> DataFrame:
    v = _profiles(spark, d).select("vec_id", p.merge_gaps(p.runs(c("m")), p.gap(F.size("m"))).alias("b"))
    return v.select("vec_id", F.array_join(F.transform("b", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("bands"))


@query(f"{_V} select vec_id, " + ", ".join(f"round(list_aggregate(a, 'quantile_cont', {q}), 6) as q{int(q * 100)}" for q in (0.05, 0.58, 0.65, 0.95)) + " from v")
def profile_quantiles(spark: SparkSession, d: str) -> DataFrame:
    v = _profiles(spark, d)
    return v.select("vec_id", *(F.round(p.quantile(c("a"), q), 6).alias(f"q{int(q * 100)}") for q in (0.05, 0.58, 0.65, 0.95)))


@query(
    f"{_V}, q as (select vec_id, a, list_avg(a) as mean, list_stddev_pop(a) as sd, list_aggregate(a, 'quantile_cont', 0.65) as q65 from v), t as (select *, list_transform(a, lambda x: x > greatest(mean * 0.75, q65 * 0.7)) as m from q), {_RUNS.replace('from v)', 'from t)')}, "
    "b as (select *, len(list_filter(range(1, len(s) + 1), lambda k: e[k] - s[k] + 1 <= greatest(3, len(a) // 5)))::bigint as bands, len(list_filter(a, lambda x: x < mean * 0.45)) / len(a) as gaps from r) "
    "select vec_id, round(ln(1 + greatest(1, bands)) + 1.25 * sd / (mean + 1e-6) + 0.75 * gaps, 6) as score, bands, round(gaps, 6) as gap_fraction from b"
)
def band_score(spark: SparkSession, d: str) -> DataFrame:
    v = _profiles(spark, d).select("vec_id", p.band_score(c("a")).alias("b"))
    return v.select("vec_id", F.round("b.score", 6).alias("score"), "b.bands", F.round("b.gap_fraction", 6).alias("gap_fraction"))


@query()
def band_score_smoothed(spark: SparkSession, d: str) -> DataFrame:
    v = _profiles(spark, d).select("vec_id", p.smooth("a").alias("a")).select("vec_id", p.band_score(c("a")).alias("b"))
    return v.select("vec_id", F.round("b.score", 6).alias("score"), "b.bands", F.round("b.gap_fraction", 6).alias("gap_fraction"))


@query(f"{_V} select vec_id, list_median(a) as median, list_sort(a)[(len(a) + 1) // 2] as lower_median from v")
def medians(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", p.quantile(c("a"), 0.5).alias("median"), p.lower_median(c("a")).alias("lower_median"))


_PAGES = "select user_id::varchar as item, (event_id // 2)::varchar as page, event_id as pos, case when user_id % 3 <> 0 and event_id % 10 < 8 then 90 else event_id % 4 * 90 end as left_angle, case when user_id % 3 <> 0 and event_id % 10 < 8 then 270 else event_id // 4 % 4 * 90 end as right_angle, event_type <> 'error' as left_content, event_type <> 'signup' as right_content, value % 1.0 as left_conf, 0.3 + event_id % 70 / 100.0 as right_conf from events"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    e, u = c("event_id"), c("user_id")
    spread = (u % 3 != 0) & (e % 10 < 8)
    return table(spark, d, "events").select(
        u.cast("string").alias("item"), F.expr("event_id div 2").cast("string").alias("page"), e.alias("pos"), F.when(spread, 90).otherwise(e % 4 * 90).alias("left_angle"),
        F.when(spread, 270).otherwise(F.expr("event_id div 4 % 4 * 90")).alias("right_angle"), (c("event_type") != "error").alias("left_content"), (c("event_type") != "signup").alias("right_content"),
        (c("value") % 1.0).alias("left_conf"), (0.3 + e % 70 / 100.0).alias("right_conf"),
    )


_PRIORS = f"p as ({_PAGES}), f as (select * from (select *, row_number() over (partition by item, page order by pos) as r from p) where r = 1 and left_content and right_content), s as (select *, ((left_angle = 90 and right_angle = 270) or (left_angle = 270 and right_angle = 90)) and least(left_conf, right_conf) >= 0.4 as strong, least(left_conf, right_conf) as conf from f), n as (select item, left_angle, right_angle, count(*) as eligible, count_if(strong) as n, min(conf) filter (strong) as low from s group by all), g as (select item, sum(eligible) as eligible_pages, sum(n) as opposed_pages, max((n, left_angle, right_angle, low)) filter (n > 0) as b from n group by item), priors as (select item, b[2]::bigint as prior_left, b[3]::bigint as prior_right, b[1]::bigint as supporting_pages, opposed_pages::bigint as opposed_pages, eligible_pages::bigint as eligible_pages, round(b[4], 6) as minimum_confidence from g where b[1] >= 5 and b[1] / opposed_pages >= 0.8 and b[1] / eligible_pages >= 0.25)"


@query(f"with {_PRIORS} select * from priors")
def item_prior(spark: SparkSession, d: str) -> DataFrame:
    r = layout.item_priors(_pages(spark, d))
    return r.select("item", c("prior_left").cast("long").alias("prior_left"), c("prior_right").cast("long").alias("prior_right"), "supporting_pages", "opposed_pages", "eligible_pages", F.round("minimum_confidence", 6).alias("minimum_confidence"))


_DECISION = """
case when gutter and opp and both_sides and low >= 0.4 then 'split_opposed_regions_then_vertical_reading_order'
 when gutter and both_sides and left_angle = right_angle and low >= 0.7 then case when left_angle = 180 and low < 0.9 then 'unchanged_unsafe_180' when left_angle = 0 then 'unchanged_region_agreement' else 'region_agreed_whole_page_rotation' end
 when gutter and prior_left is not null and (left_content or right_content) then
  case when not (conflict >= 0.65 and conflict > support + 0.15) and ((left_content and left_angle = prior_left and left_conf >= 0.4) or (right_content and right_angle = prior_right and right_conf >= 0.4) or (full_angle in (prior_left, prior_right) and full_conf >= 0.5))
   then 'item_prior_opposed_regions_then_vertical_reading_order' else 'unchanged_item_prior_conflict' end
 when gutter and left_content <> right_content then 'unchanged_single_region_uncertain'
 when gutter then 'unchanged_conflicting_wide_layout'
 when wide then 'unchanged_unvalidated_wide_partition'
 when full_angle <> 0 and mixed then 'unchanged_mixed_nonwide_layout'
 when full_angle <> 0 and full_conf >= case when full_angle = 180 then 0.9 else 0.5 end then 'whole_page_rotation'
 when full_angle <> 0 then 'unchanged_low_confidence' else 'unchanged' end
"""
_CASES = f"""with {_PRIORS}, i as (select p.*, pos % 5 < 3 as gutter, pos % 5 < 4 as wide, pos % 11 = 0 as mixed, pos // 3 % 4 * 90 as full_angle, pos % 97 / 97.0 as full_conf, prior_left, prior_right from p left join priors using (item)),
j as (select *, ((left_angle = 90 and right_angle = 270) or (left_angle = 270 and right_angle = 90)) as opp, left_content and right_content as both_sides, least(left_conf, right_conf) as low,
 case when left_content and left_angle = prior_left and left_conf >= 0.4 then left_conf else 0.0 end + case when right_content and right_angle = prior_right and right_conf >= 0.4 then right_conf else 0.0 end as support,
 case when left_content and left_angle <> prior_left and left_conf >= 0.4 then left_conf else 0.0 end + case when right_content and right_angle <> prior_right and right_conf >= 0.4 then right_conf else 0.0 end as conflict from i)"""


@query(f"{_CASES} select pos as event_id, {_DECISION} as transform from j")
def layout_decision(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    e = c("pos")
    i = pages.join(layout.item_priors(pages).select("item", "prior_left", "prior_right"), "item", "left").withColumns(
        {"gutter": e % 5 < 3, "wide": e % 5 < 4, "mixed": e % 11 == 0, "full_angle": F.expr("pos div 3 % 4 * 90"), "full_conf": e % 97 / F.lit(97.0)}
    )
    return layout.decide(i).select(e.alias("event_id"), "transform")


@query("select event_id, case when event_type = 'error' then 128 when value < 60 and event_id % 100 / 100.0 >= 0.1 and event_id % 100 / 100.0 < 0.65 then 384 end::bigint as tokens, case when event_type = 'error' then 'low_visual_content_region' when value < 60 and event_id % 100 / 100.0 >= 0.1 and event_id % 100 / 100.0 < 0.65 then 'dark_mount_with_local_light_content' end as reason from events")
def generation_limits(spark: SparkSession, d: str) -> DataFrame:
    g = layout.generation_limits(c("event_type") != "error", c("value"), c("event_id") % 100 / F.lit(100.0))
    return table(spark, d, "events").select("event_id", g.alias("g")).select("event_id", "g.tokens", "g.reason")


@query("with r as (select l_orderkey as page, l_linenumber as n, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as o, (l_partkey % 500)::bigint as w, l_quantity::bigint as h from lineitem) select page, o, (max(w) over (partition by page) - w) // 2 as x0, coalesce(sum(h + 28) over (partition by page order by o rows between unbounded preceding and 1 preceding), 0)::bigint as y0 from r")
def stacked_regions(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    r = table(spark, d, "lineitem").select(c("l_orderkey").alias("page"), place.cast("long").alias("o"), (c("l_partkey") % 500).alias("w"), c("l_quantity").cast("long").alias("h"))
    return layout.stack(r, "page", "o", "w", "h").select("page", "o", "x0", "y0")


_GUTTER = f"""{_V}, q as (select vec_id, a, list_aggregate(a[4:18] || a[47:61], 'quantile_cont', 0.5) as ref, a[21:44] as c from v), t as (select *, list_transform(c, lambda x: x <= ref * 0.25) as m from q), {_RUNS.replace('from v)', 'from t)')},
w as (select *, list_sort(list_transform(range(1, len(s) + 1), lambda k: {{'w': -(e[k] - s[k] + 1), 'o': abs(20 + (s[k] - 1 + e[k]) / 2 - 32), 's': s[k] - 1, 'e': e[k]}}))[1] as best from r),
x as (select *, 20 + case when best is null then list_position(c, list_min(c)) - 1 else best['s'] end as lo, 20 + case when best is null then list_position(c, list_min(c)) else best['e'] end as hi, list_aggregate(c, 'quantile_cont', 0.2) as low from w),
y as (select *, case when best is null then lo else (lo + hi) // 2 end as mid from x)
select vec_id, round_even(mid * 1280 / 64, 0)::bigint as x, round_even(lo * 1280 / 64, 0)::bigint as run_left, round_even(hi * 1280 / 64, 0)::bigint as run_right, round(a[mid + 1], 6) as minimum, round(ref, 6) as reference, round(low, 6) as central_low, round(low / greatest(ref, 1e-6), 6) as depth, round((hi - lo) / 64, 6) as share, ref >= 0.005 and low / greatest(ref, 1e-6) <= 0.25 and (hi - lo) / 64 >= 0.02 as valid from y"""


def _gutters(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", layout.gutter_evidence(c("a"), F.lit(1280)).alias("g"))


@query(_GUTTER)
def gutter_evidence(spark: SparkSession, d: str) -> DataFrame:
    g = _gutters(spark, d)
    return g.select("vec_id", "g.x", "g.run_left", "g.run_right", *(F.round(f"g.{k}", 6).alias(k) for k in ("minimum", "reference", "central_low", "depth", "share")), "g.valid")


@query(f"with g as ({_GUTTER}) select vec_id, vec_id % 3 <> 0 as wide, case when vec_id % 3 <> 0 and valid then 3 else 1 end::bigint as probes, case when vec_id % 3 <> 0 and valid then greatest(1, run_left) end as left_end, case when vec_id % 3 <> 0 and valid then least(1279, run_right) end as right_start from g")
def inspections(spark: SparkSession, d: str) -> DataFrame:
    """What to look at on a page: all of it, and both sides of a valid gutter where it is wide."""
    i = layout.inspect(_gutters(spark, d), c("g"), F.lit(1280), F.when(c("vec_id") % 3 == 0, 1000).otherwise(900))
    return i.select("vec_id", "wide", F.size("probes").cast("long").alias("probes"), F.get("probes", F.lit(1))["x1"].alias("left_end"), F.get("probes", F.lit(2))["x0"].alias("right_start"))


_GRAY = "with g as (select vec_id, list_transform(embedding, lambda x: least(255.0, floor(abs(x::double) * (vec_id % 20) * 60))) as g, vec_id % 9 / 2000.0 as ink from embeddings)"


@query(f"{_GRAY}, m as (select *, list_median(g) as mid, len(list_filter(g, lambda x: x >= 160)) / len(g) as b160, len(list_filter(g, lambda x: x >= 200)) / len(g) as b200, list_aggregate(g, 'quantile_cont', 0.05) as lo, list_aggregate(g, 'quantile_cont', 0.95) as hi from g) select vec_id, round(mid, 6) as median_luminance, round(b160, 6) as bright_fraction_160, round(b200, 6) as bright_fraction_200, round(lo, 6) as luminance_p05, round(hi, 6) as luminance_p95, ink >= 0.002 and (mid >= 80 or b160 >= 0.18) and hi - lo >= 12 as meaningful_content from m")
def content_metrics(spark: SparkSession, d: str) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.floor(F.abs(x.cast("double")) * (c("vec_id") % 20) * 60).cast("double")))
    m = table(spark, d, "embeddings").select("vec_id", layout.content_metrics(gray, c("vec_id") % 9 / F.lit(2000.0)).alias("m"))
    return m.select("vec_id", *(F.round(f"m.{k}", 6).alias(k) for k in ("median_luminance", "bright_fraction_160", "bright_fraction_200", "luminance_p05", "luminance_p95")), "m.meaningful_content")


@query(f"""{_CASES}, z as (select {_DECISION} as transform, pos % 17 <> 0 as there, pos % 6 = 0 as ambiguous, mixed, prior_left is not null as applied from j), k as (select count(*) as row_count, count_if(there)::bigint as processed, count_if(not there)::bigint as missing, count_if(there and transform not like 'unchanged%')::bigint as transformed, count_if(there and transform like 'unchanged%')::bigint as unchanged, count_if(there and ambiguous)::bigint as ambiguous, count_if(there and mixed)::bigint as mixed, count_if(there and transform like '%opposed_regions_then_vertical_reading_order%')::bigint as split_opposed, count_if(there and applied)::bigint as prior_applied from z)
select *, processed + missing = row_count and transformed + unchanged = processed as reconciled from k""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    pages, e = _pages(spark, d), c("pos")
    i = pages.join(layout.item_priors(pages).select("item", "prior_left", "prior_right"), "item", "left").withColumns(
        {"gutter": e % 5 < 3, "wide": e % 5 < 4, "mixed": e % 11 == 0, "full_angle": F.expr("pos div 3 % 4 * 90"), "full_conf": e % 97 / F.lit(97.0)}
    )
    flags = F.when(c("mixed"), F.array(F.lit("mixed_orientation_regions"))).otherwise(F.array().cast("array<string>"))
    return layout.run_counters(layout.decide(i).withColumns({"there": e % 17 != 0, "ambiguous": e % 6 == 0, "flags": flags, "prior_applied": c("prior_left").isNotNull()}))


@query()
def orientations(spark: SparkSession, d: str) -> DataFrame:
    """The orientation of masks of 48 rows, each entry of a profile a block of ink."""
    row = lambda i: F.transform("embedding", lambda x: (F.abs(x) > 0.05) & (i % 6 < 3))
    ink = F.transform(F.sequence(F.lit(0), F.lit(47)), row)
    masks = table(spark, d, "embeddings").select("vec_id", ink.alias("ink"), F.lit(64).alias("w"), F.lit(48).alias("h"))
    found = layout.orient(masks, "ink", "w", "h").select("vec_id", c("orientation").alias("o"))
    return found.select("vec_id", "o.angle", F.round("o.confidence", 6).alias("confidence"), "o.ambiguous", F.array_join("o.flags", ",").alias("flags"), layout.by_geometry(c("o"))["transform"].alias("transform"))
