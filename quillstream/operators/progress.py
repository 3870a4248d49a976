"""Progress of tasks: latest state, shares and remaining time, staleness, retention, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Seconds after which a running task counts as interrupted; how many ended ones are shown.
STALE, SHOWN = 900, 75
ACTIVE = ["running", "waiting", "paused"]
ORDER = ["running", "waiting", "paused", "failed", "interrupted", "complete"]


def latest(events: DataFrame, task: str, ts: str, order: str) -> DataFrame:
    """Each task's last event; equal times go to the larger ``order``."""
    rest = [c for c in events.columns if c != task]
    return events.groupBy(task).agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("e")).select(task, "e.*")


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * current / F.nullif(total, F.lit(0.0)))))


def eta(elapsed: Column, current: Column, total: Column) -> Column:
    """Seconds left at the pace so far; 0 when done, null before anything is."""
    return F.when(total > 0, F.when(current >= total, 0.0).when(current > 0, elapsed * (total - current) / F.nullif(current, F.lit(0.0))))


def status(stated: Column, age: Column) -> Column:
    """A running task that has been silent for too long is interrupted."""
    return F.when((stated == "running") & (age > STALE), "interrupted").otherwise(stated)


def snapshot(states: DataFrame, retention_hours: float, shown: int = SHOWN) -> DataFrame:
    """Tasks (task, name, status, age) worth showing, with ``place``: all active ones and the
    youngest of those that ended within the retention, by status and name.

    Ranks are taken on what is left after the retention; the ``shown`` youngest are a top-k.
    """
    s = states.withColumn("status", status(F.col("status"), F.col("age")))
    active = F.col("status").isin(*ACTIVE)
    ended = s.where(~active & ((F.col("status") == "running") | (F.col("age") <= retention_hours * 3600))).orderBy("age", "task").limit(shown)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")), F.lit(0)), F.lit(10)) - 1
    both = s.where(active).unionByName(ended).withColumn("rank", rank)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy("name", "task")).cast("long"))


def by_command(processes: DataFrame) -> DataFrame:
    """Processes grouped by command: sums of cpu and memory, workers, the longest-running one, and a
    status of the set of states: paused if one is stopped, waiting if all sleep, else running."""
    g = processes.groupBy("command").agg(
        F.round(F.sum("cpu"), 6).alias("cpu"), F.sum("memory").alias("memory"), F.count("*").alias("workers"),
        F.max_by("pid", F.struct("elapsed", (-F.col("pid")).alias("p"))).alias("primary_pid"), F.collect_set("state").alias("states"),
    )
    asleep = F.forall("states", lambda s: s.isin("S", "I"))
    return g.withColumn("status", F.when(F.array_contains("states", "T"), "paused").when(asleep, "waiting").otherwise("running")).drop("states")


#: What a progress file calls its two numbers, in the order in which they are looked for, the
#: flags that name a number of epochs or a folder, and the metrics that are shown.
PAIRS = [("current", "total"), ("processed", "total"), ("completed", "total"), ("page", "pages_total"), ("item", "items_total")]
EPOCH_FLAGS, OUTPUT_FLAGS = ("epochs", "num-epochs", "num_epochs"), ("output", "output-dir", "output_dir")
METRICS = ["loss", "train_loss", "validation_loss", "iou", "validation_iou", "f1", "precision", "recall", "validation_recall", "accuracy", "cer", "wer"]


def useful_metrics(json: Column) -> Column:
    """The numbers of a JSON object under METRICS, as a map."""
    return t.numbers_of(json, METRICS)


def inferred(processes: DataFrame, reports: DataFrame, metrics: DataFrame) -> DataFrame:
    """Progress of processes (pid, command, folder, elapsed) that don't report it themselves: current, total,
    percent, eta, confidence and message of each.

    ``reports`` (folder, report) has the JSON of a progress file, ``metrics`` (folder, pos, record) the
    records of a metrics file. A report's pair of numbers counts first; else the last record's epoch
    against the command's number of epochs; else that there is activity is all that is known.
    """
    pairs = F.array(*(F.struct(*(F.element_at("numbers", F.lit(k)).alias(n) for k, n in zip(pair, ("current", "total"), strict=True))) for pair in PAIRS))
    names = sorted({k for pair in PAIRS for k in pair})
    first = F.get(F.filter(pairs, lambda x: x["current"].isNotNull() & (x["total"] > 0)), F.lit(0))
    r = reports.withColumn("numbers", t.numbers_of(F.col("report"), names)).select("folder", first.alias("said"), F.get_json_object("report", "$.message").alias("word"))
    last = metrics.where(F.try_parse_json("record").isNotNull() & F.startswith(F.trim("record"), F.lit("{"))).groupBy("folder").agg(F.max_by("record", "pos").alias("record"))
    epoch = F.element_at(t.numbers_of(F.col("record"), ["epoch"]), F.lit("epoch"))
    epochs = t.argument_value(F.col("command"), *EPOCH_FLAGS).try_cast("double")
    j = processes.join(r, "folder", "left").join(last, "folder", "left").withColumn("e", F.struct(epoch.alias("current"), epochs.alias("total")))
    reported = F.col("said").isNotNull()
    by_epoch = ~reported & F.col("e.current").isNotNull() & (F.col("e.total") > 0)
    pick = F.when(reported, F.col("said")).when(by_epoch, F.col("e"))
    j = j.withColumn("at", pick)
    confidence = F.when(reported, "reported").when(F.col("record").isNotNull(), "inferred from metrics").otherwise("activity-only")
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    ratio = F.concat(plain(F.col("at.current")), F.lit("/"), plain(F.col("at.total")))
    message = (
        F.when(reported, F.coalesce("word", ratio)).when(by_epoch, F.concat(F.lit("epoch "), ratio, F.lit(" complete; next epoch is active")))
        .when(F.col("record").isNotNull(), "metrics are updating; total is unknown").otherwise("active; exact percentage is not exposed")
    )
    left = F.when((F.col("at.current") > 0) & (F.col("at.current") < F.col("at.total")), eta(F.col("elapsed").cast("double"), F.col("at.current"), F.col("at.total")))
    return j.select("pid", F.col("at.current").alias("current"), F.col("at.total").alias("total"), percent(F.col("at.current"), F.col("at.total")).alias("percent"), left.alias("eta"), confidence.alias("confidence"), message.alias("message"))


def unreported(processes: DataFrame, tasks: DataFrame, *pids: str) -> DataFrame:
    """Processes (pid) that no task names in one of its ``pids`` columns."""
    known = tasks.select(F.explode(F.array_compact(F.array(*(F.col(c).cast("long") for c in pids)))).alias("pid")).distinct()
    return processes.join(known, "pid", "left_anti")


def all_tasks(explicit: DataFrame, passive: DataFrame) -> DataFrame:
    """Tasks that report themselves and those that were found, with the source of each; columns that one side lacks are null."""
    return explicit.withColumn("source", F.lit("explicit")).unionByName(passive.withColumn("source", F.lit("passive")), allowMissingColumns=True)


def tracked(lines: DataFrame, tail: int = 30) -> DataFrame:
    """State of tracked commands from their output (task, pos, line, exit_code; the code null but on the last
    row): current, total and metrics of the last line that tells them, the last ``tail`` lines, and a status."""
    p = lines.withColumns({"p": t.parse_progress(F.col("line")), "m": t.line_metrics(F.col("line"))})
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("pos")))
    ends = p.withColumn("back", place)
    g = ends.groupBy("task").agg(
        F.max_by("p", F.when(F.col("p").isNotNull(), F.col("pos"))).alias("at"), F.max_by("m", F.when(F.size("m") > 0, F.col("pos"))).alias("metrics"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("back") <= tail, F.struct("pos", "line")))), lambda x: x["line"]).alias("last_lines"), F.max("exit_code").alias("exit_code"),
    )
    status_ = F.when(F.col("exit_code").isNull(), "running").when(F.col("exit_code") == 0, "complete").otherwise("failed")
    return g.select("task", "at.current", "at.total", "metrics", "last_lines", status_.alias("status"))
