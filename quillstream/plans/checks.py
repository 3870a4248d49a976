"""Queries over the checks of manifests and predictions; turns stand for regions, with faults planted by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import manifest as m
from ..operators import merge
from . import sql
from .registry import query, table

c = F.col
BOUND, CONFIG = ["parent", "idx", "image"], ["model", "decode_profile", "settings"]


def _id() -> Column:
    return F.concat_ws(":", c("conv_id").cast("string"), c("turn").cast("string"))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(_id().alias("id"), F.concat(F.lit("p"), c("conv_id").cast("string")).alias("provenance"), c("conv_id").alias("parent"), c("turn").alias("idx"), c("role").alias("image"))


_GIVEN = """conv_id * 1000 + turn as pos, case when conv_id % 11 = 4 and turn = 0 then 'x' else 'p' || conv_id end as provenance, conv_id as parent, case when conv_id % 13 = 5 and turn = 1 then turn + 1 else turn end as idx,
 case when conv_id % 9 = 2 and turn = 1 then 'other' else role end as image, case when conv_id % 17 = 6 and turn = 0 then ' ' else 'm' end as model, 'd' as decode_profile, case when conv_id % 19 = 7 then 's2' else 's1' end as settings"""
_ID = "conv_id || ':' || turn"


def _given(spark: SparkSession, d: str) -> DataFrame:
    """Predictions: every tenth conversation repeats its first, every twelfth has one of an older run."""
    turns = table(spark, d, "conversations")
    every = turns.selectExpr(f"{_ID} as id", *_GIVEN_PARTS)
    twice = turns.where("conv_id % 10 = 3 and turn = 0").selectExpr(f"{_ID} as id", *_GIVEN_PARTS)
    stale = turns.where("conv_id % 12 = 8 and turn = 0").selectExpr(f"{_ID} || '_old' as id", *_GIVEN_PARTS)
    return every.unionByName(twice).unionByName(stale)


_GIVEN_PARTS = [
    "conv_id * 1000 + turn as pos", "case when conv_id % 11 = 4 and turn = 0 then 'x' else 'p' || conv_id end as provenance", "conv_id as parent", "case when conv_id % 13 = 5 and turn = 1 then turn + 1 else turn end as idx",
    "case when conv_id % 9 = 2 and turn = 1 then 'other' else role end as image", "case when conv_id % 17 = 6 and turn = 0 then ' ' else 'm' end as model", "'d' as decode_profile", "case when conv_id % 19 = 7 then 's2' else 's1' end as settings",
]
_GIVEN_SQL = f"g as (select {_ID} as id, {_GIVEN} from conversations union all select {_ID}, {_GIVEN} from conversations where conv_id % 10 = 3 and turn = 0 union all select {_ID} || '_old', {_GIVEN} from conversations where conv_id % 12 = 8 and turn = 0)"


@query(f"""with {_GIVEN_SQL}, n as (select id, count(*) as copies, arg_min({{'provenance': provenance, 'parent': parent, 'idx': idx, 'image': image, 'model': model, 'settings': settings}}, pos) as p from g group by id),
e as (select {_ID} as id, 'p' || conv_id as provenance, conv_id as parent, turn as idx, role as image from conversations), f as (select arg_min(model, pos) as model, arg_min(settings, pos) as settings from g),
j as (select n.id, copies, p, e.id as known, e.provenance as ep, e.parent as epa, e.idx as ei, e.image as eim, f.model as fm, f.settings as fs from n left join e on e.id = n.id cross join f),
r as (select id, case when copies > 1 then 'duplicate_id' when known is null then 'unexpected_or_stale_id' when p.provenance <> ep then 'provenance_mismatch' when p.parent <> epa or p.idx <> ei or p.image <> eim then 'field_mismatch' when trim(p.model) = '' then 'incomplete_config' when p.model <> fm or p.settings <> fs then 'mixed_config' end as problem,
 case when p.parent <> epa then 'parent' when p.idx <> ei then 'idx' when p.image <> eim then 'image' end as off from j)
select id, problem, case when problem = 'field_mismatch' then off end as field from r where problem is not null""")
def rejected_predictions(spark: SparkSession, d: str) -> DataFrame:
    return m.rejected_predictions(_given(spark, d), _expected(spark, d), BOUND, CONFIG)


_REGION = """case when conv_id % 10 = 4 and turn = 1 then '  ' when conv_id % 10 = 5 and turn = 1 then conv_id || '-0' when conv_id % 10 = 6 and turn = 0 then 'shared' else conv_id || '-' || turn end as id,
 case when conv_id % 10 = 3 and turn = 0 then 'another' else conv_id::varchar end as parent_id, case when turn % 6 = 5 then '' else 'i' || turn end as image"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", *(x.replace("conv_id::varchar", "cast(conv_id as string)").strip() for x in _REGION_PARTS))
    pages = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id", "parent_id", "image"))), lambda x: F.struct(x["id"].alias("id"), x["parent_id"].alias("parent_id"), x["image"].alias("image"))).alias("regions"))
    return pages.unionByName(pages.where("conv_id % 20 = 8").withColumn("regions", F.filter("regions", lambda r: F.lit(False))))


_REGION_PARTS = [
    "case when conv_id % 10 = 4 and turn = 1 then '  ' when conv_id % 10 = 5 and turn = 1 then conv_id || '-0' when conv_id % 10 = 6 and turn = 0 then 'shared' else conv_id || '-' || turn end as id",
    "case when conv_id % 10 = 3 and turn = 0 then 'another' else conv_id::varchar end as parent_id", "case when turn % 6 = 5 then '' else 'i' || turn end as image",
]


@query(f"""with r as (select conv_id::varchar as page, {_REGION} from conversations), s as (select distinct page, unnest([case when image = '' then 'region_without_image' end, case when parent_id <> page then 'mismatched_parent' end, case when trim(id) = '' then 'blank_region_id' end]) as problem from r),
k as (select id, count(distinct page) as pages, count(*) as n from r group by id), x as (select distinct r.page, case when pages > 1 then 'region_id_on_several_pages' else 'duplicate_region_id' end as problem from r join k using (id) where pages > 1 or n > 1)
select page, problem from s where problem is not null union select page, problem from x union select distinct conv_id::varchar, 'duplicate_page_id' from conversations where conv_id % 20 = 8""")
def rejected_regions(spark: SparkSession, d: str) -> DataFrame:
    return m.rejected_regions(_pages(spark, d), "conv_id", "regions")


@query("select conv_id as page, greatest(1, count(*) filter (turn % 3 <> 0))::bigint as regions, coalesce(min('t' || turn) filter (turn % 3 <> 0), conv_id::varchar) as first_id from conversations group by conv_id")
def default_regions(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<id:string,parent_id:string,reading_order:int,region:string,image:string,meaningful_content:boolean>>"
    found = F.collect_list(F.when(c("turn") % 3 != 0, F.struct(F.concat(F.lit("t"), c("turn").cast("string")).alias("id"), c("conv_id").cast("string").alias("parent_id"), c("turn").cast("int").alias("reading_order"), F.lit("part").alias("region"), c("role").alias("image"), F.lit(True).alias("meaningful_content"))))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(found).cast(kind).alias("r"))
    r = pages.select(c("conv_id").alias("page"), m.with_default_region(c("r"), c("conv_id"), F.lit("whole.jpg")).alias("r"))
    return r.select("page", F.size("r").cast("long").alias("regions"), F.element_at("r", 1)["id"].alias("first_id"))


_L = f"with l as (select doc_id, {sql.lines('text')} as ls from documents), r as (select doc_id, unnest(ls) as x, unnest(range(0, len(ls))) as i from l)"


@query(f"{_L} select doc_id, i::bigint as region_index, case when length(x) < 20 then 128 end::int as generation_max_new_tokens, null::int as generation_max_incomplete_retries, case when length(x) < 20 then 'short' end as generation_limit_reason from r")
def region_settings(spark: SparkSession, d: str) -> DataFrame:
    """A page's own limits give way to those of its regions."""
    short = lambda x: F.length(x) < 20
    one = lambda x, i: F.struct(F.lit("").alias("id"), i.alias("reading_order"), x.alias("source"), F.lit(True).alias("meaningful_content"), F.when(short(x), 128).alias("generation_max_new_tokens"), F.when(short(x), "short").alias("generation_limit_reason"))
    pages = table(spark, d, "documents").select("doc_id", F.lit(999).alias("generation_max_new_tokens"), F.lit("page").alias("generation_limit_reason"), F.transform(t.lines(c("text")), one).alias("regions"))
    return m.region_settings(m.expand_regions(pages, "doc_id", "regions")).select("doc_id", "region_index", *m.GENERATION)


_TURNS = "with r as (select conv_id as parent, turn as idx, case when turn % 5 = 4 then '  ' else text end as prediction, turn % 5 <> 4 or conv_id % 2 = 0 as meaningful, not (conv_id % 7 = 3 and turn = 1) as there, 'raw ' || turn as raw, 'm' || turn as model, case when turn % 3 = 2 then ['x' || turn] else [] end as reasons from conversations)"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Regions joined with their predictions, of which some pages lack one; two are of no region."""
    turns = table(spark, d, "conversations")
    regions = turns.select(_id().alias("id"), c("conv_id").alias("parent"), c("turn").alias("idx"), ((c("turn") % 5 != 4) | (c("conv_id") % 2 == 0)).alias("meaningful"))
    reasons = F.when(c("turn") % 3 == 2, F.array(F.concat(F.lit("x"), c("turn").cast("string")))).otherwise(F.array().cast("array<string>"))
    p = turns.where("not (conv_id % 7 = 3 and turn = 1)").select(_id().alias("id"), F.when(c("turn") % 5 == 4, "  ").otherwise(c("text")).alias("prediction"), reasons.alias("reasons"), F.concat(F.lit("raw "), c("turn").cast("string")).alias("raw"), F.concat(F.lit("m"), c("turn").cast("string")).alias("model"))
    other = p.limit(2).withColumn("id", F.concat(F.lit("unknown "), "id"))
    return merge.joined(regions, p.unionByName(other))


@query(f"{_TURNS} select parent, coalesce(string_agg(trim(prediction), chr(10) order by idx) filter (trim(prediction) <> ''), '') as prediction, count(*) as regions, bool_or(len(reasons) > 0) as incomplete, array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') as reasons from r group by parent having bool_and(there and (not meaningful or trim(prediction) <> ''))")
def merge_joined(spark: SparkSession, d: str) -> DataFrame:
    """Complete pages from a join of regions and predictions."""
    return merge.merge_pages(_joined(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"{_TURNS} select parent, string_agg(case when there then raw else '' end, ',' order by idx) as raw_regions, case when arg_min(there, idx) then arg_min(model, idx) end as model, count(*) as expected, count_if(there)::bigint as completed from r group by parent")
def page_details(spark: SparkSession, d: str) -> DataFrame:
    return merge.page_details(_joined(spark, d), "model").withColumn("raw_regions", F.array_join("raw_regions", ","))


@query("with r as (select l_orderkey::varchar as page_id, l_suppkey % 3 as column_id, case when l_partkey % 4 <> 0 then l_linenumber end as line_in_column, l_linenumber % 3 as line_id, l_returnflag as image, case when l_partkey % 2 = 0 then '' else 'm' || l_partkey end as matched_text, 't' || l_suppkey as text, l_partkey * 100000 + l_suppkey + l_extendedprice as pos from lineitem), s as (select *, row_number() over (partition by page_id, line_id, image order by column_id, coalesce(line_in_column, line_id), pos) as k from r) select printf('%s_line_%04d', page_id, line_id) as id, page_id, line_id::int as line_id, column_id::int as column_id, coalesce(line_in_column, line_id)::int as line_in_column, image, case when matched_text <> '' then matched_text else text end as target, 'polygon_lines' as condition from s where k = 1")
def line_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        c("l_orderkey").cast("string").alias("page_id"), (c("l_suppkey") % 3).alias("column_id"), F.when(c("l_partkey") % 4 != 0, c("l_linenumber")).alias("line_in_column"), (c("l_linenumber") % 3).alias("line_id"), c("l_returnflag").alias("image"),
        F.when(c("l_partkey") % 2 == 0, "").otherwise(F.concat(F.lit("m"), c("l_partkey").cast("string"))).alias("matched_text"), F.concat(F.lit("t"), c("l_suppkey").cast("string")).alias("text"), (c("l_partkey") * 100000 + c("l_suppkey") + c("l_extendedprice")).alias("pos"),
    )
    return m.line_items(rows)


@query("select item_id::varchar as id, 'i' || item_id as image, text as target, 'support_page' as condition, 'i3' as support_image, (select text from benchmark where item_id = 3) as support_text from benchmark")
def page_items(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "benchmark").select(c("item_id").cast("string").alias("id"), F.concat(F.lit("i"), c("item_id").cast("string")).alias("image"), c("text").alias("target"))
    return m.page_items(pages, "3")


@query("select doc_id, lang from documents where doc_id in (1, 2, 5, 150)")
def only_ids(spark: SparkSession, d: str) -> DataFrame:
    return m.only_ids(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", ["150", "2", "5", "1"])


@query("select doc_id, lang from documents order by doc_id limit 7")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """A limit that is asked for."""
    return m.first_rows(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 7)


@query("select page_id, case when page_id % 3 = 0 then 'root' || page_id when page_id % 3 = 1 then 'original' else url end as source, case when page_id % 4 = 0 then 'portable' else url end as inference, url as remapped from pages where url <> ''")
def source_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").where("url <> ''").select("page_id", F.when(c("page_id") % 3 == 0, F.concat(F.lit("root"), c("page_id").cast("string"))).otherwise("").alias("root_original_image"), F.when(c("page_id") % 3 == 1, "original").alias("original_image"), c("url").alias("image"), F.when(c("page_id") % 4 == 0, "portable").alias("inference_image"), "url")
    return m.remap(rows.withColumns({"source": m.source_path(rows), "inference": m.inference_image(rows)}), "url", "remapped").select("page_id", "source", "inference", "remapped")


@query("select d.doc_id, l.doc_id is not null as there from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id")
def missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    return m.missing_inputs(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("select doc_id, 'shard/' || sha256(text) || '.jpg' as image, lang || '.JPG' as original_image from documents")
def portable_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.concat("lang", F.lit(".JPG")).alias("image"))
    return m.portable(rows, "h", "image", "shard/").select("doc_id", "image", "original_image")


@query("with r as (select doc_id, lang, source, sha256(text) as image from documents) select a.doc_id, min(b.doc_id::varchar) as negative from r a left join r b on a.lang = b.lang and a.source <> b.source and a.image <> b.image and b.doc_id % 5 <> 0 group by a.doc_id")
def counterfactual_present(spark: SparkSession, d: str) -> DataFrame:
    """Counterfactual negatives where the images of some rows are missing."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("image"))
    return m.counterfactual_negatives(docs, "lang", "source", "image", "doc_id", c("doc_id") % 5 != 0).select("doc_id", "negative")


@query("select (select count(*) from (select l_orderkey from lineitem except select o_orderkey from orders)) + (select count(*) from (select o_orderkey from orders except select l_orderkey from lineitem)) = 0 as same")
def same_parents(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"))
    return spark.createDataFrame([(m.same_parents(have, table(spark, d, "orders").select(c("o_orderkey").alias("k")), "k"),)], "same boolean")


@query("select event_id, (i and not k) or (i and s and not l) or (f and p) as again from (select event_id, event_id % 2 = 0 as i, event_id % 3 = 0 as k, event_id % 5 < 3 as s, event_id % 7 = 0 as l, event_id % 11 = 0 as f, event_type = 'click' as p from events)")
def retry_wanted(spark: SparkSession, d: str) -> DataFrame:
    e = c("event_id")
    return table(spark, d, "events").select("event_id", merge.retry_wanted(e % 2 == 0, e % 7 == 0, e % 5 < 3, e % 3 == 0, e % 11 == 0, c("event_type") == "click").alias("again"))
