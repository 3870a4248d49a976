"""Manifests: identity, regions and their provenance, uniqueness, reconciliation, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def stem(path: Column) -> Column:
    """A file's name without folders and its last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def identity(*precedence: Column | str) -> Column:
    """The page's identity by an explicit order of columns; an error where all are missing."""
    found = present(*precedence)
    return F.when(F.trim(found) != "", found).otherwise(F.raise_error(F.lit("row without a page identity")).cast("string"))


def item_identity(item: Column) -> Column:
    """The item's identity if it is given: no other column stands in for it, as others are too broad; else empty."""
    return F.coalesce(item.cast("string"), F.lit(""))


def page_key(first: Column | str, second: Column | str, image: Column) -> Column:
    """(id, image) that tells a page's rows apart: an id that may be missing, and the image's path without . and .. parts."""
    parts = F.filter(F.split(F.coalesce(image, F.lit("")), "/+"), lambda p: ~p.isin("", "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    path = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))
    return F.struct(F.coalesce(present(first, second), F.lit("")).alias("id"), path.alias("image"))


def task_type(value: Column) -> Column:
    """page or line from their aliases; null and empty: page; an error otherwise."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("", "page", "fullpage", "full_page"), "page").when(v.isin("line", "lines"), "line").otherwise(F.raise_error(F.concat(F.lit("unknown task type "), v)).cast("string"))


def keep_meaningful(regions: Column) -> Column:
    """Regions with meaningful content (a missing flag counts as true); all of them if none has."""
    kept = F.filter(regions, lambda r: F.coalesce(r["meaningful_content"], F.lit(True)))
    return F.when(F.size(kept) == 0, regions).otherwise(kept)


def expand_regions(pages: DataFrame, page_id: str, regions: str, version: str = "provenance.v1") -> DataFrame:
    """One row per region, numbered in reading order from 0, with a chain of SHA-256 digests.

    ``regions`` is an array of structs with id, reading_order, source and meaningful_content; ties
    in the order keep their place. A page's digest covers its id and source, a layout's all its
    regions in order, a region's both and its own place, so an id changes with whatever it rests on.
    """
    placed = F.transform(regions, lambda r, i: F.struct(F.coalesce(r["reading_order"], F.lit(0)).alias("o"), i.alias("p"), r.alias("r")))
    rows = pages.withColumn("_sorted", F.transform(F.array_sort(placed), lambda x: x["r"]))
    one = lambda r: F.concat_ws("|", F.coalesce(r["id"], F.lit("")), F.coalesce(r["reading_order"], F.lit(0)).cast("string"), F.sha2(F.coalesce(r["source"], F.lit("")), 256))
    rows = rows.withColumn("layout_sha256", F.sha2(F.concat_ws("\n", F.lit(version), F.col(page_id).cast("string"), F.array_join(F.transform("_sorted", one), "\n")), 256))
    rows = rows.withColumn("region_count", F.size("_sorted").cast("long")).withColumn("_x", keep_meaningful(F.col("_sorted")))
    rows = rows.select("*", F.posexplode("_x").alias("_i", "_r"))
    logical = F.coalesce(F.nullif(F.col("_r.id"), F.lit("")), F.format_string("%s__region_%02d", F.col(page_id).cast("string"), "_i"))
    digest = F.sha2(F.concat_ws("|", "layout_sha256", logical, F.col("_i").cast("string")), 256)
    return rows.select(
        *(c for c in pages.columns if c != regions), logical.alias("logical_id"), F.col("_i").cast("long").alias("region_index"), F.size("_x").cast("long").alias("kept_count"),
        "region_count", F.col("_r").alias("region"), "layout_sha256", digest.alias("region_sha256"), F.concat(logical, F.lit("__provenance_"), F.left(digest, F.lit(20))).alias("bound_id"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "copies")


def reconcile(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Distinct keys on one side alone, with ``side`` missing (wanted, not there) or extra."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    missing, extra = b.join(a, key, "left_anti"), a.join(b, key, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def bound_differences(have: DataFrame, want: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both sides whose bound fields differ: key and the names of the fields that do."""
    j = have.select(key, *(F.col(f).alias(f"h_{f}") for f in fields)).join(want.select(key, *fields), key)
    off = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"h_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return j.select(key, off.alias("fields")).where(F.size("fields") > 0)


def broken_numbering(rows: DataFrame, parent: str, index: str, first: int = 0) -> DataFrame:
    """Parents whose indices aren't first, first + 1, ... without gaps and repeats."""
    g = rows.groupBy(parent).agg(F.count("*").alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.count_distinct(index).alias("different"))
    return g.where((F.col("lo") != first) | (F.col("hi") != F.col("n") + first - 1) | (F.col("different") != F.col("n")))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def counterfactual_negatives(rows: DataFrame, task: str, item: str, image: str, key: str, there: Column | None = None) -> DataFrame:
    """For each row the smallest key (as text) of a row with the same task, another item and another image.

    Only rows whose image is there (``there``; null: all are) can be the other row.

    Five rows per task answer all: A, the smallest of all, fits every row but those that share its
    item or its image. For its item's rows, B is the smallest of other items, and C the smallest of
    other items with another image than B's. For its image's rows, D and E are found likewise. So
    nothing is compared with everything; each of the five is one aggregate.
    """
    it, im = F.coalesce(F.col(item), F.lit("")), F.coalesce(F.col(image), F.lit(""))
    base = (rows if there is None else rows.where(there)).select(F.col(task).alias("task"), it.alias("item"), im.alias("image"), F.col(key).cast("string").alias("k"))
    least = base.groupBy("task", "item", "image").agg(F.min("k").alias("k"))
    best = least.groupBy("task").agg(F.min(F.struct("k", "item", "image")).alias("a"))
    for name, where in (("b", "item <> a.item"), ("c", "item <> a.item and image <> b.image"), ("d", "image <> a.image"), ("e", "image <> a.image and item <> d.item")):
        g = least.join(best, "task").where(where).groupBy("task").agg(F.min(F.struct("k", "item", "image")).alias(name))
        best = best.join(g, "task", "left")
    out = rows.withColumns({"_t": F.col(task), "_i": it, "_m": im}).join(best.withColumnRenamed("task", "_t"), "_t", "left")
    own_item, own_image = F.col("_i") == F.col("a.item"), F.col("_m") == F.col("a.image")
    answer = (
        F.when(~own_item & ~own_image, F.col("a.k"))
        .when(own_item, F.when(F.col("_m") != F.col("b.image"), F.col("b.k")).otherwise(F.col("c.k")))
        .otherwise(F.when(F.col("_i") != F.col("d.item"), F.col("d.k")).otherwise(F.col("e.k")))
    )
    return out.select(*rows.columns, answer.alias("negative"))


def dedupe_shard(rows: DataFrame, content: str, key: str) -> DataFrame:
    """Each row with the digest of its content and the smallest key that has it; ``copied`` on that one."""
    h = rows.withColumn("content_sha256", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    first = h.groupBy("content_sha256").agg(F.min(key).alias("shard_key"))
    return h.join(first, "content_sha256").withColumn("copied", F.col("shard_key") == F.col(key))


def remap(rows: DataFrame, source: str, field: str = "image") -> DataFrame:
    """``field`` replaced by column ``source``; an error for a row that lacks it."""
    value = present(F.col(source).cast("string"))
    return rows.withColumn(field, F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"a row lacks {source}")).cast("string")))


def source_path(rows: DataFrame) -> Column:
    """Where a page came from: the first of root_original_image, original_image, layout_input_image and
    image that ``rows`` has and that isn't empty."""
    known = [c for c in ("root_original_image", "original_image", "layout_input_image", "image") if c in rows.columns]
    return present(*known)


def inference_image(rows: DataFrame) -> Column:
    """The image to recognise: inference_image where that is given, else image."""
    return present(*[c for c in ("inference_image", "image") if c in rows.columns])


def only_ids(rows: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """The rows with one of ``ids``; an error that names those that no row has."""
    asked = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "asked string")
    found = rows.where(F.col(key).cast("string").isin(*ids))
    lost = asked.join(found.select(F.col(key).cast("string").alias("asked")), "asked", "left_anti").orderBy("asked")
    names = [r.asked for r in lost.limit(20).collect()]
    if names:
        raise KeyError(f"not in the manifest: {names}")
    return found


def first_rows(rows: DataFrame, order: str, n: int | None, zero_is_all: bool = True) -> DataFrame:
    """The first ``n`` rows by ``order`` (a limit that is asked for); none given: all, and 0 too unless it counts."""
    return rows if n is None or (n == 0 and zero_is_all) else rows.orderBy(order).limit(n)


def missing_inputs(rows: DataFrame, image: str, files: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with ``there``: whether their image is among ``files``. Distinct paths are joined once."""
    have = files.select(F.col(path).alias("_have")).distinct()
    return rows.join(have, F.col(image) == F.col("_have"), "left").withColumn("there", F.col("_have").isNotNull()).drop("_have")


#: What tells why a prediction isn't taken, in the order in which it is looked at.
PREDICTION_PROBLEMS = ["duplicate_id", "unexpected_or_stale_id", "provenance_mismatch", "field_mismatch", "incomplete_config", "mixed_config", "unexpected_config"]


def rejected_predictions(predictions: DataFrame, regions: DataFrame, bound: list[str], config: list[str], wanted: dict[str, str] | None = None) -> DataFrame:
    """id, problem and field of each prediction that must not be merged; one row per id.

    ``predictions``: pos, id, provenance, and the columns ``bound`` and ``config``; ``regions``: id,
    provenance and ``bound``. Every prediction must be of an expected region, once, with that
    region's provenance and bound fields, and all must share the first one's config, whose model and
    decode_profile aren't empty; ``wanted`` gives values that config columns must have. Ids are
    counted and joined by equality; the first config is one row.
    """
    first = F.min_by(F.struct(*config), "pos").alias("first")
    count = predictions.groupBy("id").agg(F.count("*").alias("copies"), F.min_by(F.struct("provenance", *dict.fromkeys([*bound, *config])), "pos").alias("p"))
    r = regions.select("id", F.struct("provenance", *bound).alias("r"), F.lit(True).alias("expected"))
    j = count.join(r, "id", "left").crossJoin(F.broadcast(predictions.agg(first)))  # one row
    off = F.filter(F.array(*(F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in bound)), lambda x: x.isNotNull())
    empty = [F.coalesce(F.trim(F.col(f"p.{c}").cast("string")), F.lit("")) == "" for c in config if c in ("model", "decode_profile")]
    lacks = F.array_contains(F.array(*empty), True) if empty else F.lit(False)
    mixed = F.array_contains(F.array(*(~F.col(f"p.{c}").eqNullSafe(F.col(f"first.{c}")) for c in config)), True)
    other = F.array_contains(F.array(F.lit(False), *(~F.col(f"p.{c}").eqNullSafe(F.lit(v)) for c, v in (wanted or {}).items())), True)
    gates = [F.col("copies") > 1, F.col("expected").isNull(), ~F.col("p.provenance").eqNullSafe(F.col("r.provenance")), F.size(off) > 0, lacks, mixed, other]
    problem = F.coalesce(*(F.when(g, F.lit(name)) for g, name in zip(gates, PREDICTION_PROBLEMS, strict=True)))
    field = F.when(problem == "field_mismatch", F.get(off, F.lit(0)))
    return j.select("id", problem.alias("problem"), field.alias("field")).where("problem is not null")


def accepted(predictions: DataFrame, regions: DataFrame, bound: list[str], config: list[str], wanted: dict[str, str] | None = None) -> DataFrame:
    """``predictions`` if none is rejected; else an error that names some."""
    bad = rejected_predictions(predictions, regions, bound, config, wanted).orderBy("id").limit(10).collect()
    if bad:
        raise ValueError("rejected predictions: " + "; ".join(f"{r.id}: {r.problem}" + (f" ({r.field})" if r.field else "") for r in bad))
    return predictions


def rejected_regions(pages: DataFrame, page_id: str, regions: str) -> DataFrame:
    """page and problem: page ids that occur twice, and regions without image, of another parent, with a
    blank id, or with an id that occurs twice, on a page or across pages.

    ``regions`` is an array of structs with id, parent_id and image; an id that is missing is made of
    the page's and the place.
    """
    page = F.col(page_id).cast("string").alias("page")
    copies = pages.groupBy(page).count().where("count > 1").select("page", F.lit("duplicate_page_id").alias("problem"))
    made = F.format_string("%s__region_%02d", "page", "i")
    r = pages.select(page, F.posexplode(F.col(regions)).alias("i", "r")).select("page", F.coalesce(F.nullif("r.id", F.lit("")), made).alias("id"), "r.parent_id", "r.image")
    rules = [
        (F.coalesce(F.col("image"), F.lit("")) == "", "region_without_image"), (F.col("parent_id") != F.col("page"), "mismatched_parent"), (F.trim("id") == "", "blank_region_id"),
    ]
    single = r.select("page", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))).alias("problem"))
    ids = r.groupBy("id", "page").count().groupBy("id").agg(F.count("*").alias("pages"), F.max("count").alias("most"), F.collect_list("page").alias("at"))
    shared = ids.where("pages > 1 or most > 1").select(F.explode("at").alias("page"), F.when(F.col("pages") > 1, "region_id_on_several_pages").otherwise("duplicate_region_id").alias("problem"))
    return copies.unionByName(single).unionByName(shared).distinct()


def with_default_region(regions: Column, page_id: Column, image: Column) -> Column:
    """The regions of a page; for a page without any, one that covers all of it."""
    full = F.array(F.struct(page_id.cast("string").alias("id"), page_id.cast("string").alias("parent_id"), F.lit(0).alias("reading_order"), F.lit("full").alias("region"), image.alias("image"), F.lit(True).alias("meaningful_content")))
    return F.when(F.coalesce(F.size(regions), F.lit(0)) == 0, full).otherwise(regions)


#: Columns that say how a row is to be recognised; a region's own replace the page's.
GENERATION = ["generation_max_new_tokens", "generation_max_incomplete_retries", "generation_limit_reason"]


def region_settings(expanded: DataFrame, region: str = "region") -> DataFrame:
    """The page's GENERATION columns give way to its region's, or to null where the region has none."""
    have = set(expanded.schema[region].dataType.names)
    kinds = {"generation_limit_reason": "string"}
    own = [(F.col(f"{region}.{c}") if c in have else F.lit(None)).cast(kinds.get(c, "int")).alias(c) for c in GENERATION]
    return expanded.select(*(c for c in expanded.columns if c not in GENERATION), *own)


def same_parents(have: DataFrame, want: DataFrame, key: str) -> bool:
    """Whether both sides have the same keys."""
    return reconcile(have, want, key).isEmpty()


def line_items(lines: DataFrame, pages: list[str] | None = None) -> DataFrame:
    """Line rows (page_id, column_id, line_in_column, line_id, image, text, matched_text) to recognise: of
    each (page, line, image) the first in reading order (then by ``pos``, if there), with an id, the target text and its place."""
    n = lambda c, other: F.coalesce(F.col(c).cast("int"), other)
    rows = lines if pages is None else lines.where(F.col("page_id").isin(*pages))
    rows = rows.withColumns({"column_id": n("column_id", F.lit(0)), "line_id": F.col("line_id").cast("int")})
    rows = rows.withColumn("line_in_column", n("line_in_column", F.col("line_id")))
    order = [F.col(c) for c in ("page_id", "column_id", "line_in_column", "line_id", "pos") if c in rows.columns]
    first = F.row_number().over(Window.partitionBy("page_id", "line_id", "image").orderBy(*order)) == 1
    rows = rows.withColumn("_first", first).where("_first")
    target = F.coalesce(present("matched_text"), F.col("text"), F.lit(""))
    return rows.select(F.format_string("%s_line_%04d", "page_id", "line_id").alias("id"), "page_id", "line_id", "column_id", "line_in_column", "image", target.alias("target"), F.lit("polygon_lines").alias("condition"))


def page_items(pages: DataFrame, support: str | None = None) -> DataFrame:
    """Pages (id, image, target) to recognise, each with the image and text of the page ``support`` as an example, if given."""
    if support is None:
        return pages.select("id", "image", "target", F.lit("plain").alias("condition"), F.lit(None).cast("string").alias("support_image"), F.lit(None).cast("string").alias("support_text"))
    one = pages.where(F.col("id") == support).select(F.col("image").alias("support_image"), F.col("target").alias("support_text")).limit(1)
    return pages.crossJoin(F.broadcast(one)).select("id", "image", "target", F.lit("support_page").alias("condition"), "support_image", "support_text")  # one row


def portable(rows: DataFrame, content_sha256: str, image: str, folder: str) -> DataFrame:
    """``rows`` whose image path points into a shard's folder: the content's digest with the old suffix."""
    suffix = F.lower(F.regexp_extract(image, r"(\.[A-Za-z0-9]+)$", 1))
    return rows.withColumn("original_image", F.col(image)).withColumn(image, F.concat(F.lit(folder.rstrip("/") + "/"), F.col(content_sha256), suffix))
