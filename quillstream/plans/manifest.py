"""Queries over manifests, joins and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import manifest as m
from ..operators import merge
from . import sql
from .registry import query, table

c = F.col
_REGIONS = "transform(text_lines, (x, i) -> struct('' as id, cast(i as int) as reading_order, x as source, length(x) >= 20 as meaningful_content))"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", t.lines(c("text")).alias("text_lines"))
    return docs.select("doc_id", F.expr(_REGIONS).alias("regions"))


_LINES = f"with l as (select doc_id, {sql.lines('text')} as ls from documents), k as (select doc_id, ls, list_filter(ls, lambda x: length(x) >= 20) as long from l), e as (select doc_id, ls, case when len(long) = 0 then ls else long end as kept from k), h as (select *, sha256(concat_ws(chr(10), 'provenance.v1', doc_id::varchar, array_to_string(list_transform(range(0, len(ls)), lambda i: concat_ws('|', '', i::varchar, sha256(ls[i + 1]))), chr(10)))) as lay from e), r as (select doc_id, lay, len(ls) as total, len(kept) as n, unnest(kept) as x, unnest(range(0, len(kept))) as i from h)"


@query(f"{_LINES} select doc_id, i::bigint as region_index, n::bigint as kept_count, total::bigint as region_count, length(x)::bigint as n_chars from r")
def expand_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as regions, one per line; short lines count as without content unless all are short."""
    e = m.expand_regions(_regions(spark, d), "doc_id", "regions")
    return e.select("doc_id", "region_index", "kept_count", "region_count", F.length("region.source").cast("long").alias("n_chars"))


@query(f"{_LINES} select doc_id, i::bigint as region_index, lay as layout_sha256, sha256(concat_ws('|', lay, printf('%s__region_%02d', doc_id::varchar, i), i::varchar)) as region_sha256 from r")
def provenance_ids(spark: SparkSession, d: str) -> DataFrame:
    e = m.expand_regions(_regions(spark, d), "doc_id", "regions")
    return e.select("doc_id", "region_index", "layout_sha256", "region_sha256")


@query("select case when page_id % 2 = 0 and url <> '' then url else 'p' || page_id end as identity, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*?)(?:\\.[^./]*)?$', 1) as stem from pages")
def identities(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(c("page_id") % 2 == 0, c("url")).otherwise("")
    return table(spark, d, "pages").select(m.identity(first, F.concat(F.lit("p"), "page_id")).alias("identity"), m.stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))


@query("select task, count(*) as row_count from (select case when event_type in ('click', 'view') then 'page' else 'line' end as task from events) group by task")
def task_counts(spark: SparkSession, d: str) -> DataFrame:
    alias = F.when(c("event_type") == "click", "Full_Page").when(c("event_type") == "view", "").otherwise(" lines ")
    return table(spark, d, "events").select(m.task_type(alias).alias("task")).groupBy("task").agg(F.count("*").alias("row_count"))


@query("select o_custkey, count(*) as copies from orders group by o_custkey having count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return m.duplicates(table(spark, d, "orders"), "o_custkey")


@query("select page_id, case when page_id % 3 = 0 then '' else 'i' || page_id end as item, case when page_id % 2 = 0 then 'p' || page_id when page_id % 5 <> 0 then url else '' end as id, '/a/c/' || page_id || '.jpg' as image from pages")
def page_keys(spark: SparkSession, d: str) -> DataFrame:
    n = c("page_id").cast("string")
    key = m.page_key(F.when(c("page_id") % 2 == 0, F.concat(F.lit("p"), n)), F.when(c("page_id") % 5 != 0, c("url")).otherwise(""), F.concat(F.lit("/a/./b//../c/"), n, F.lit(".jpg")))
    pages = table(spark, d, "pages").select("page_id", m.item_identity(F.when(c("page_id") % 3 != 0, F.concat(F.lit("i"), n))).alias("item"), key.alias("k"))
    return pages.select("page_id", "item", "k.id", "k.image")


@query("(select l_orderkey as k, 'extra' as side from lineitem except select o_orderkey, 'extra' from orders) union all (select o_orderkey, 'missing' from orders except select l_orderkey, 'missing' from lineitem)")
def missing_extra(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"))
    return m.reconcile(have, table(spark, d, "orders").select(c("o_orderkey").alias("k")), "k")


@query("select l_orderkey, count(*) as n, min(l_linenumber)::bigint as lo, max(l_linenumber)::bigint as hi, count(distinct l_linenumber) as different from lineitem group by l_orderkey having min(l_linenumber) <> 1 or max(l_linenumber) <> count(*) or count(distinct l_linenumber) <> count(*)")
def broken_numbering(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("l_linenumber", c("l_linenumber").cast("long"))
    return m.broken_numbering(lines, "l_orderkey", "l_linenumber", 1)


@query("select o_orderkey, case when o_totalprice <> floor(o_totalprice) then 'o_totalprice' else '' end as fields from orders where o_totalprice <> floor(o_totalprice)")
def bound_differences(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a copy whose prices are cut to whole numbers."""
    o = table(spark, d, "orders")
    have = o.withColumn("o_totalprice", F.floor("o_totalprice").cast("double"))
    return m.bound_differences(have, o, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"]).withColumn("fields", F.array_join("fields", ","))


@query("select l_returnflag, count(distinct l_linestatus) as configs, count(distinct l_linestatus) > 1 as mixed from lineitem group by l_returnflag")
def mixed_config(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_linestatus").alias("configs"))
    return g.withColumn("mixed", c("configs") > 1)


@query("select doc_id, lang from documents anti join labels using (doc_id)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return m.pending(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("select source, count(*) as documents, count(l.doc_id) as covered from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id group by source")
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(c("doc_id").alias("known")).distinct()
    return table(spark, d, "documents").join(labels, c("doc_id") == c("known"), "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("known").alias("covered"))


@query("select count(*) as all_keys, count_if(a is not null and b is not null)::bigint as matched, count_if(b is null)::bigint as left_only, count_if(a is null)::bigint as right_only from (select d.doc_id as a, l.doc_id as b from documents d full join (select doc_id + 3 as doc_id from labels) l on l.doc_id = d.doc_id)")
def verifier_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(c("doc_id").alias("a"))
    j = a.join(table(spark, d, "labels").select((c("doc_id") + 3).alias("b")), c("a") == c("b"), "full")
    return j.agg(F.count("*").alias("all_keys"), F.count_if(c("a").isNotNull() & c("b").isNotNull()).alias("matched"), F.count_if(c("b").isNull()).alias("left_only"), F.count_if(c("a").isNull()).alias("right_only"))


@query("with r as (select doc_id, lang, source, sha256(text) as image from documents) select a.doc_id, min(b.doc_id::varchar) as negative from r a left join r b on a.lang = b.lang and a.source <> b.source and a.image <> b.image group by a.doc_id")
def counterfactual_negative(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("image"))
    return m.counterfactual_negatives(docs, "lang", "source", "image", "doc_id").select("doc_id", "negative")


@query("select doc_id, sha256(text) as content_sha256, min(doc_id) over (partition by sha256(text)) as shard_key, doc_id = min(doc_id) over (partition by sha256(text)) as copied from documents")
def shard_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return m.dedupe_shard(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "content_sha256", "shard_key", "copied")


_TURNS = "with r as (select conv_id, turn, role, case when turn % 5 = 4 then '  ' else text end as prediction, turn % 5 <> 4 or conv_id % 2 = 0 as meaningful, not (conv_id % 7 = 3 and turn = 1) as there, case when turn % 3 = 2 then ['explicit_omission_placeholder', 'x' || turn] else [] end as reasons from conversations)"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as regions: some blank, some of these without meaning, some conversations lacking one."""
    return table(spark, d, "conversations").select(
        c("conv_id").alias("parent"), c("turn").alias("idx"), "role", F.when(c("turn") % 5 == 4, "  ").otherwise(c("text")).alias("prediction"),
        ((c("turn") % 5 != 4) | (c("conv_id") % 2 == 0)).alias("meaningful"), (~((c("conv_id") % 7 == 3) & (c("turn") == 1))).alias("there"),
        F.when(c("turn") % 3 == 2, F.array(F.lit("explicit_omission_placeholder"), F.concat(F.lit("x"), c("turn").cast("string")))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


_MERGED = "conv_id as parent, coalesce(string_agg(trim(prediction), chr(10) order by turn) filter (trim(prediction) <> ''), '') as prediction, count(*) as regions, bool_or(len(reasons) > 0) as incomplete, array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') as reasons"


@query(f"{_TURNS} select {_MERGED} from r group by conv_id having bool_and(there and (not meaningful or trim(prediction) <> ''))")
def merge_complete(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_pages(_predictions(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"{_TURNS} select {_MERGED} from r where there group by conv_id")
def merge_partial(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_pages(_predictions(spark, d), partial=True).withColumn("reasons", F.array_join("reasons", ","))


@query(f"{_TURNS} select conv_id as parent, coalesce(string_agg(turn::varchar, ',' order by turn) filter (not there), '') as missing, coalesce(string_agg(turn::varchar, ',' order by turn) filter (there and meaningful and trim(prediction) = ''), '') as empty from r group by conv_id having not bool_and(there and (not meaningful or trim(prediction) <> ''))")
def incomplete_pages(spark: SparkSession, d: str) -> DataFrame:
    return merge.incomplete_pages(_predictions(spark, d))


_ATTEMPTS = "with r as (select conv_id, turn, text, case when turn % 4 = 1 then 2 when turn % 4 = 2 then 1 else 0 end as tier from conversations)"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(c("turn") % 4 == 1, 2).when(c("turn") % 4 == 2, 1).otherwise(0)
    return table(spark, d, "conversations").select("conv_id", "turn", "text", (tier >= 1).alias("complete"), (tier == 2).alias("xml"))


@query(f"{_ATTEMPTS} select conv_id, arg_max(turn, (tier, length(text), -turn))::bigint as turn from r group by conv_id")
def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    return merge.best_attempt(_attempts(spark, d), "conv_id", "turn", "text", "complete", "xml").select("conv_id", c("turn").cast("long").alias("turn"))


@query(f"{_ATTEMPTS} select conv_id, arg_max(turn, (tier >= 1, length(text), -turn))::bigint as turn from r group by conv_id")
def best_attempt_simple(spark: SparkSession, d: str) -> DataFrame:
    return merge.best_attempt(_attempts(spark, d), "conv_id", "turn", "text", "complete").select("conv_id", c("turn").cast("long").alias("turn"))


@query(f"{_ATTEMPTS}, s as (select *, coalesce(min(turn) filter (tier = 2) over (partition by conv_id), 1000000) as stop from r) select conv_id, turn from s where turn <= stop")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return merge.until_clean(_attempts(spark, d), "conv_id", "turn", "xml").select("conv_id", "turn")


@query("with r as (select conv_id, turn, greatest(32, least(2048, case when role = 'user' then 16 when length(text) % 2 = 0 then 384 else 4096 end))::bigint as token_limit from conversations), i as (select *, case when token_limit = lag(token_limit) over w then 0 else 1 end as new from r window w as (partition by conv_id order by turn)), g as (select *, sum(new) over (partition by conv_id order by turn) as island from i) select conv_id, turn, token_limit, island::bigint as island, ((row_number() over (partition by conv_id, island order by turn) - 1) // 2)::bigint as part from g")
def adjacency_batches(spark: SparkSession, d: str) -> DataFrame:
    cap = F.when(c("role") == "user", 16).when(F.length("text") % 2 == 0, 384).otherwise(4096)
    rows = table(spark, d, "conversations").select("conv_id", "turn", merge.token_limit(cap, F.lit(None).cast("string"), F.lit(False), 2048).alias("token_limit"))
    return merge.adjacent_batches(rows, "conv_id", "turn", "token_limit", 2)
