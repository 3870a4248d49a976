"""Merging regions into pages; attempts; batches of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def lacking(there: Column, meaningful: Column, prediction: Column) -> Column:
    """A region that keeps its page from being complete: absent, or blank though it has content."""
    return ~there | (meaningful & blank(prediction))


def merge_pages(rows: DataFrame, partial: bool = False) -> DataFrame:
    """Pages from region rows (parent, idx, prediction, meaningful, there, reasons): texts in reading
    order without blank ones, the number of regions, whether any is incomplete, and all reasons, sorted.

    A page that lacks a region is left out; with ``partial`` it is merged from what is there. What a
    page gathers is bounded by its own regions; flags are aggregated before the shuffle.
    """
    part = F.when(~blank(F.col("prediction")), F.struct("idx", F.trim("prediction").alias("x")))
    r = rows.where("there") if partial else rows
    g = r.groupBy("parent").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda s: s["x"]), "\n").alias("prediction"),
        F.count("*").alias("regions"),
        F.bool_or(F.size("reasons") > 0).alias("incomplete"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.bool_or(lacking(F.col("there"), F.col("meaningful"), F.col("prediction"))).alias("_lacks"),
    )
    return (g if partial else g.where("not _lacks")).drop("_lacks")


def joined(regions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Region rows for merge_pages(): every expected region (id, parent, idx, meaningful) with its prediction
    (id, prediction, reasons, and whatever else it has), ``there`` false where none came.

    A left join by id. Predictions of other regions are left out; see manifest.rejected_predictions().
    """
    p = predictions.withColumn("there", F.lit(True))
    j = regions.select("id", "parent", "idx", "meaningful").join(p, "id", "left")
    return j.withColumns({"there": F.coalesce("there", F.lit(False)), "reasons": F.coalesce("reasons", F.array().cast("array<string>")), "meaningful": F.coalesce("meaningful", F.lit(True))})


def page_details(rows: DataFrame, *config: str) -> DataFrame:
    """What else a merged page has, from the rows of merge_pages(): the raw texts in reading order, the
    first region's ``config`` columns, and how many regions are expected and came."""
    g = rows.groupBy("parent").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("raw", F.lit("")).alias("x")))), lambda s: s["x"]).alias("raw_regions"),
        F.min_by(F.struct(*config), "idx").alias("first"), F.count("*").alias("expected"), F.count_if("there").alias("completed"),
    )
    return g.select("parent", "raw_regions", "first.*", "expected", "completed")


def incomplete_pages(rows: DataFrame) -> DataFrame:
    """Pages that can't be merged, with the places of absent regions and of blank ones with content."""
    off = rows.where(lacking(F.col("there"), F.col("meaningful"), F.col("prediction")))
    names = lambda where: F.array_join(F.sort_array(F.collect_list(F.when(where, F.col("idx")))).cast("array<string>"), ",")
    return off.groupBy("parent").agg(names(~F.col("there")).alias("missing"), names(F.col("there")).alias("empty"))


def best_attempt(rows: DataFrame, key: str, attempt: str, text: str, complete: str, xml: str | None = None) -> DataFrame:
    """Of each key's attempts the best: complete XML (if ``xml`` says so) before complete before others, then the longest, then the earliest."""
    whole = F.col(complete)
    tier = (F.when(whole & F.col(xml), 2).when(whole, 1) if xml else F.when(whole, 1)).otherwise(0)
    rank = F.struct(tier.alias("tier"), F.length(text).alias("size"), (-F.col(attempt)).alias("early"))
    return rows.groupBy(key).agg(F.max_by(F.struct(attempt, text), rank).alias("b")).select(key, "b.*")


def retry_wanted(incomplete: Column, loop_stopped: Column, selective: Column, continuous: Column, forced: Column, is_page: Column) -> Column:
    """Whether a first attempt is tried again: it is incomplete and the budget isn't continuous; or it is
    incomplete, recovery is selective and no loop ended it; or retries are forced and it is a page."""
    known = lambda c: F.coalesce(c, F.lit(False))
    i = known(incomplete)
    return (i & ~known(continuous)) | (i & known(selective) & ~known(loop_stopped)) | (known(forced) & known(is_page))


def until_clean(rows: DataFrame, key: str, attempt: str, clean: str) -> DataFrame:
    """Attempts up to the first clean one; all where none is."""
    first = F.min(F.when(F.col(clean), F.col(attempt))).over(Window.partitionBy(key))
    return rows.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(attempt) <= F.col("_first"))).drop("_first")


def token_limit(cap: Column, reason: Column, continuous: Column, most: int) -> Column:
    """At least 32 and at most ``most`` tokens; a continuous budget heeds a row's cap only if it has a reason."""
    capped = F.greatest(F.lit(32), F.least(F.lit(most), F.coalesce(F.nullif(cap, F.lit(0)), F.lit(most))))
    free = F.greatest(F.lit(32), F.lit(most))
    return F.when(continuous & (F.coalesce(reason, F.lit("")) == ""), free).otherwise(capped).cast("long")


def retry_cap(asked: Column, selective: Column, continuous: Column) -> Column:
    """Retries: none below 0, none for a continuous budget without selection, one at most with it."""
    n = F.greatest(F.lit(0), asked)
    return F.when(selective, F.least(n, F.lit(1))).when(continuous, F.lit(0)).otherwise(n)


def adjacent_batches(rows: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Runs of neighbours with equal values (island, from 1), cut into parts of ``size`` (part, from 0)."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    r = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "island").orderBy(order)
    return r.withColumn("part", F.floor((F.row_number().over(inner) - 1) / size)).drop("_new")
