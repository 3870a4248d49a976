"""Queries over single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values as v
from ..operators import progress as p
from .registry import query, table

c = F.col


@query("with b as (select l_orderkey, l_linenumber, l_partkey % 50 as x0, l_suppkey % 7 as y0, l_partkey % 60 as x1, l_suppkey % 9 as y1, case when l_linenumber % 4 = 3 then 'n/a' else (l_partkey % 60)::varchar end as word from lineitem), k as (select *, l_linenumber % 4 <> 3 and x1 > x0 and y1 > y0 as fine from b) select l_orderkey, l_linenumber, sum(case when fine then (x1 - x0) * (y1 - y0) end)::double as area, count(*) as copies from k group by all")
def boxes(spark: SparkSession, d: str) -> DataFrame:
    """The area of boxes, from arrays on odd lines, from columns on even ones; some have a word for a number."""
    edges = [c("l_partkey") % 50, c("l_suppkey") % 7, F.when(c("l_linenumber") % 4 == 3, "n/a").otherwise((c("l_partkey") % 60).cast("string")), c("l_suppkey") % 9]
    array = F.when(c("l_linenumber") % 2 == 1, F.array(*(x.cast("string") for x in edges))).otherwise(F.array(F.lit("1")))
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.bbox(array, *edges).alias("b"))
    area = (c("b.x1") - c("b.x0")) * (c("b.y1") - c("b.y0"))
    return b.groupBy("l_orderkey", "l_linenumber").agg(F.sum(area).alias("area"), F.count("*").alias("copies"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') as at from events")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", v.iso_utc(c("ts")).alias("at"))


@query("select event_id, case when event_id % 7 in (1, 2) then null else value end as finite, greatest(10, least(60, value)) as clamped from events")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(c("event_id") % 7 == 1, float("nan")).when(c("event_id") % 7 == 2, float("inf")).otherwise(c("value"))
    return table(spark, d, "events").select("event_id", v.finite(odd).alias("finite"), v.clamp(c("value"), 10.0, 60.0).alias("clamped"))


@query("select event_id, sha256('{\"a\":[' || event_id || ',2],\"k\":' || (props->>'$.k') || ',\"é\":null}') as digest, sha256('{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}') as known from events")
def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digests of JSON whose keys come in another order and with spaces, and of objects with known fields."""
    text = F.concat(F.lit('{ "é" : null, "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": ['), c("event_id").cast("string"), F.lit(", 2]}"))
    return table(spark, d, "events").select("event_id", v.canonical_hash(text).alias("digest"), v.object_hash({"user": c("user_id"), "kind": c("event_type")}).alias("known"))


@query("select doc_id, left(sha256(source || '/' || doc_id || '|' || n_chars || '|' || doc_id * 1000), 10) as fingerprint from documents")
def source_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "source", c("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", v.source_fingerprint(path, c("n_chars"), c("doc_id") * 1000).alias("fingerprint"))


@query("with e as (select event_id, event_id % 30 as a, event_id % 30 + event_id % 4 as b, (event_id % 9)::double / 2 as s from events) select event_id, (b - a + 2)::bigint as layers, (b - a + 1) * s + 1 as total, 35::int as last, 'o_proj' as part, s as part_scale from e")
def scales(spark: SparkSession, d: str) -> DataFrame:
    """Scales of layers and of their parts, as run arguments write them."""
    a, b, s = c("event_id") % 30, c("event_id") % 30 + c("event_id") % 4, ((c("event_id") % 9).cast("double") / 2).cast("string")
    x = table(spark, d, "events").select("event_id", v.layer_scales(F.array(F.concat(F.lit("35:"), F.lit("1.0")), F.concat_ws(":", F.concat_ws("-", a.cast("string"), b.cast("string")), s))).alias("l"), v.part_scales(F.array(F.concat_ws(":", a.cast("string"), F.lit("o_proj"), s))).alias("p"))
    return x.select("event_id", F.size("l").cast("long").alias("layers"), F.aggregate("l", F.lit(0.0), lambda t_, e: t_ + e["scale"]).alias("total"), F.element_at("l", -1)["layer"].alias("last"), c("p")[0]["part"].alias("part"), c("p")[0]["scale"].alias("part_scale"))


_COMMAND = "'python3 -u /srv/run_' || event_type || '.py --epochs' || case when event_id % 2 = 0 then '=' else ' ' end || event_id % 50 || ' --output /o/' || user_id"


@query(f"with e as (select event_id, event_type, event_id % 50 as n, user_id from events) select event_id, 'run ' || event_type as name, n::varchar as epochs, '/o/' || user_id as folder, 'python3' as program from e")
def command_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.expr(_COMMAND).alias("x"))
    return e.select("event_id", t.human_name(c("x")).alias("name"), t.argument_value(c("x"), "num-epochs", "epochs").alias("epochs"), t.argument_value(c("x"), *p.OUTPUT_FLAGS).alias("folder"), t.human_name(F.lit("/usr/bin/python3 -c pass")).alias("program"))


@query("select event_id, case when event_id % 4 = 3 then 0 else 2 end::bigint as n, case when event_id % 4 <> 3 then value end as loss, case when event_id % 4 <> 3 then 0.5::double end as f1 from events")
def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that a line of output has, with colours around it and other entries in it."""
    said = F.concat(F.lit("\x1b[1m{\"loss\": "), c("value").cast("string"), F.lit(", \"f1\": 0.5, \"note\": \"x\", \"cer\": true, \"other\": 3}\x1b[0m"))
    x = table(spark, d, "events").select("event_id", t.line_metrics(F.when(c("event_id") % 4 != 3, said).otherwise("loss 3")).alias("m"))
    return x.select("event_id", F.size("m").cast("long").alias("n"), c("m")["loss"].alias("loss"), c("m")["f1"].alias("f1"))
