"""Queries over progress; events stand for reports, a user for a task. Now is the last event's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import progress as p
from .registry import query, table

c = F.col
_LATEST = "l as (select user_id, max(event_id) as event_id, max(ts) as ts from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 group by user_id), s as (select e.* from l join events e on e.event_id = l.event_id and e.user_id = l.user_id), now as (select max(ts) as now from events)"
_STATUS = "case event_type when 'click' then 'running' when 'view' then 'waiting' when 'purchase' then 'complete' when 'error' then 'failed' else 'running' end"


@query(f"with {_LATEST} select user_id, event_id, event_type, value from s")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return p.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("with e as (select event_id, event_id % 100 * 1.0 as elapsed, value, event_id % 60 * 1.0 as total from events) select event_id, round(case when total > 0 then greatest(0, least(100, 100 * value / total)) end, 6) as percent, round(case when total > 0 then case when value >= total then 0.0 when value > 0 then elapsed * (total - value) / value end end, 6) as eta from e")
def eta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (c("event_id") % 100).cast("double").alias("elapsed"), "value", (c("event_id") % 60).cast("double").alias("total"))
    return e.select("event_id", F.round(p.percent(c("value"), c("total")), 6).alias("percent"), F.round(p.eta(c("elapsed"), c("value"), c("total")), 6).alias("eta"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    stated = F.when(c("event_type") == "click", "running").when(c("event_type") == "view", "waiting").when(c("event_type") == "purchase", "complete").when(c("event_type") == "error", "failed").otherwise("running")
    now = events.agg(F.max("ts").alias("now"))
    s = p.latest(events, "user_id", "ts", "event_id").crossJoin(F.broadcast(now))  # one row
    age = F.unix_micros(c("now").cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp"))
    return s.select(c("user_id").alias("task"), F.concat(F.lit("task "), c("user_id").cast("string")).alias("name"), stated.alias("status"), (age / 1e6).alias("age"))


_STATES = f"with {_LATEST}, t as (select user_id as task, 'task ' || user_id as name, {_STATUS} as st, (epoch_us(now) - epoch_us(ts)) / 1e6 as age from s, now), u as (select task, name, case when st = 'running' and age > 900 then 'interrupted' else st end as status, age from t)"


@query(f"{_STATES} select task, status from u")
def interrupted(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("task", p.status(c("status"), c("age")).alias("status"))


@query(f"{_STATES}, k as (select * from u where status not in ('running', 'waiting', 'paused') and age <= 72 * 3600 order by age, task limit 75), b as (select *, case status when 'running' then 0 when 'waiting' then 1 when 'paused' then 2 when 'failed' then 3 when 'interrupted' then 4 when 'complete' then 5 else 9 end as rank from (select * from u where status in ('running', 'waiting', 'paused') union all select * from k)) select task, status, rank::bigint as rank, row_number() over (partition by rank order by name, task) as place from b")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All active tasks and the 75 youngest ended ones of the last 72 hours (a top-k report)."""
    return p.snapshot(_states(spark, d), 72).select("task", "status", c("rank").cast("long").alias("rank"), "place")


@query("select event_type as command, round(sum(value), 6) as cpu, sum(user_id)::bigint as memory, count(*) as workers, arg_max(event_id, (event_id % 1000, -event_id)) as primary_pid, case when event_type = 'click' then 'paused' when event_type = 'error' then 'waiting' else 'running' end as status from events group by event_type")
def process_groups(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(c("event_type") == "click", "T").when(c("event_type") == "error", "I").otherwise("R")
    state = F.when(c("event_id") % 3 == 1, "S").otherwise(other)
    e = table(spark, d, "events").select(c("event_type").alias("command"), c("value").alias("cpu"), c("user_id").alias("memory"), c("event_id").alias("pid"), (c("event_id") % 1000).alias("elapsed"), state.alias("state"))
    return p.by_command(e)


@query("select event_id, case when event_id % 3 = 1 then 1 when event_id % 3 = 2 then 0 else 2 end::bigint as n, case when event_id % 3 = 0 then value end as f1, case event_id % 3 when 0 then (props->>'$.k')::double when 1 then 0.25 end as loss from events")
def useful_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The known metrics of reports that also have others, strings and booleans."""
    k = F.get_json_object("props", "$.k")
    both = F.concat(F.lit('{"loss": '), k, F.lit(', "f1": '), c("value").cast("string"), F.lit(', "speed": 4, "cer": "x", "wer": true}'))
    m = table(spark, d, "events").select("event_id", p.useful_metrics(F.when(c("event_id") % 3 == 0, both).when(c("event_id") % 3 == 1, '{"loss": 0.25, "recall": null}').otherwise("[1]")).alias("m"))
    return m.select("event_id", F.size("m").cast("long").alias("n"), c("m")["f1"].alias("f1"), c("m")["loss"].alias("loss"))


@query("""with e as (select event_id as pid, 'f' || event_id as folder, event_id % 40 as elapsed, event_id % 6 as k, event_id % 20 + 1 as n, event_id % 30 as a from events),
r as (select pid, case when k = 0 then a when k = 1 then a when k = 2 then n end::double as current, case when k = 0 then n * 2 when k = 1 then 25 when k = 2 then 50 end::double as total, case when k in (0, 1) then 'reported' when k in (2, 3) then 'inferred from metrics' else 'activity-only' end as confidence,
 case when k = 0 then a || '/' || n * 2 when k = 1 then 'on its way' when k = 2 then 'epoch ' || n || '/50 complete; next epoch is active' when k = 3 then 'metrics are updating; total is unknown' else 'active; exact percentage is not exposed' end as message, elapsed from e)
select pid, current, total, case when total > 0 then round(greatest(0, least(100, 100 * current / total)), 6) end as percent, round(case when current > 0 and current < total then elapsed * (total - current) / current end, 6) as eta, confidence, message from r""")
def passive_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress that processes don't report: a third have a progress file, a third a metrics file."""
    e = table(spark, d, "events").select("event_id", (c("event_id") % 6).alias("k"), (c("event_id") % 20 + 1).cast("string").alias("n"), (c("event_id") % 20 * 2 + 2).cast("string").alias("t"), (c("event_id") % 30).cast("string").alias("a"), F.concat(F.lit("f"), c("event_id").cast("string")).alias("folder"))
    command = F.when(c("k") == 2, "train.py --num-epochs=50").otherwise("train.py")
    processes = e.select(c("event_id").alias("pid"), "folder", command.alias("command"), (c("event_id") % 40).alias("elapsed"))
    two = F.concat(F.lit('{"total": '), c("t"), F.lit(', "processed": '), c("a"), F.lit(', "current": "?"}'))
    reports = e.where("k in (0, 1, 4)").select("folder", F.when(c("k") == 0, two).when(c("k") == 1, F.concat(F.lit('{"page": '), c("a"), F.lit(', "pages_total": 25, "message": "on its way"}'))).otherwise('{"current": 3}').alias("report"))
    some = e.where("k in (1, 2, 3)")
    metrics = some.select("folder", F.lit(1).alias("pos"), F.lit('{"epoch": 1}').alias("record")).unionByName(some.select("folder", F.lit(2).alias("pos"), F.concat(F.lit('{"epoch": '), c("n"), F.lit(', "loss": 0.5}')).alias("record"))).unionByName(some.select("folder", F.lit(3).alias("pos"), F.lit('{"epoch"').alias("record")))
    return p.inferred(processes, reports, metrics).select("pid", "current", "total", F.round("percent", 6).alias("percent"), F.round("eta", 6).alias("eta"), "confidence", "message")


@query("select event_id as pid, event_type from events where event_id not in (select doc_id from labels) and event_id not in (select doc_id + 500 from labels)")
def unreported(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "labels").select(c("doc_id").alias("pid"), (c("doc_id") + 500).alias("worker"))
    return p.unreported(table(spark, d, "events").select(c("event_id").alias("pid"), "event_type"), tasks, "pid", "worker")


@query("select user_id as task, event_type as status, null::double as cpu, 'explicit' as source from events where event_id % 2 = 0 union all select user_id, null, value, 'passive' from events where event_id % 2 = 1")
def all_tasks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("task", c("user_id"))
    return p.all_tasks(e.where("event_id % 2 = 0").select("task", c("event_type").alias("status")), e.where("event_id % 2 = 1").select("task", c("value").alias("cpu"))).select("task", "status", "cpu", "source")


@query("""with l as (select user_id as task, event_id as pos, event_id % 4 as k, row_number() over (partition by user_id order by event_id desc) as back from events),
g as (select task, max(pos) filter (k = 0) as a, max(pos) filter (k = 1) as m, string_agg(pos::varchar, ',' order by pos) filter (back <= 30) as last_lines, max(pos) as top from l group by task)
select task, (a % 50)::double as current, case when a is not null then 50.0::double end as total, (m % 10)::double as loss, last_lines, case when task % 3 = 0 then 'running' when task % 3 = 1 then 'complete' else 'failed' end as status from g""")
def tracked_commands(spark: SparkSession, d: str) -> DataFrame:
    """State of commands from lines of output: ratios, metrics, other lines, and an exit code at the end of some."""
    e, k, s = c("event_id"), c("event_id") % 4, lambda x: x.cast("string")
    line = F.when(k == 0, F.concat(F.lit("page "), s(e % 50), F.lit("/50"))).when(k == 1, F.concat(F.lit('{"loss": '), s(e % 10), F.lit("}"))).otherwise(F.concat(F.lit("working on "), s(e)))
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))) == 1
    code = F.when(last & (c("user_id") % 3 == 1), 0).when(last & (c("user_id") % 3 == 2), 2)
    r = p.tracked(table(spark, d, "events").select(c("user_id").alias("task"), e.alias("pos"), line.alias("line"), code.alias("exit_code")))
    # The lines' numbers, found again by their place in the task.
    numbered = table(spark, d, "events").withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("back <= 30")
    names = numbered.groupBy(c("user_id").alias("task")).agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("want"))
    same = c("last_lines") == F.transform("want", lambda x: x["line"])
    j = r.join(names, "task").withColumn("last_lines", F.when(same, F.array_join(F.transform("want", lambda x: x["event_id"].cast("string")), ",")))
    return j.select("task", "current", "total", c("metrics")["loss"].alias("loss"), "last_lines", "status")
