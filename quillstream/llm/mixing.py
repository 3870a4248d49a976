"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, table


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a document; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``i``: the source's place by code point, null last, without bringing all sources to one task.

    Range-partitioned sort; the number of rows before each partition is a sum over the partitions,
    of which there are as many as tasks.
    """
    ordered = scratch(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
    )
    counts = ordered.groupBy("part").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left")
    before = before.groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        ordered.join(F.broadcast(before), "part")
        .withColumn("i", F.col("before") + F.row_number().over(within) - 1)
        .drop("part", "before")
    )


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, none above ``most`` times the source's size.

    What the cap cuts off is shared again by weight among the rest until no source is above. Each
    round is one small aggregate over one row per source; every round but the last caps a source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    s = scratch(ranked(sources).withColumn("w", w))
    total, cap = s.agg(F.sum("source_size")).first()[0] or 0, F.lit(most) * F.col("source_size")
    left, weight, capped = total, None, F.lit(False)
    while True:
        # One job a round: the weights that still share, how many they are, and what the others took.
        row = s.agg(F.sum(F.when(~capped, F.col("w"))), F.count_if(~capped), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0))).first()
        new_left = total - most * row[2]
        if weight is not None and (new_left, row[0]) == (left, weight) or not row[1]:
            break
        left, weight = new_left, row[0]
        # left * w / weight > cap, in whole numbers.
        capped = F.lit(left).cast("decimal(38,0)") * F.col("w") > cap.cast("decimal(30,0)") * F.lit(weight)
    share = F.lit(float(left)) * F.col("w").cast("double") / F.lit(float(weight or 1))
    return s.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share)).drop("w", "i")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """row (a struct of all columns of ``docs``), doc_id, size, source_size, target and copies of each row.

    A document is taken floor(rate) times, and once more if the fraction exceeds a number in [0, 1)
    made of the MD5 of seed and doc_id; reruns agree. Defined cases: a null text has size 0; a null
    source is a source of its own, the last; an empty table gives an empty one; rows that repeat a
    doc_id are decided alike; a source whose size is 0 has target 0; columns may have any name, as
    they stay within the struct. Sizes are summed per source before the shuffle, and only one row
    per source is joined back, so a hot source costs nothing.
    """
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", sizes(docs).alias("size"))
    per = docs.select("source", sizes(docs).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    per = scratch(per)
    t = targets(per, weights, most).withColumnRenamed("source", "of")
    # One row per source: joined by AQE as a broadcast where it is small, else by a sort-merge join
    # whose hot keys AQE splits.
    d = d.join(t, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "source")
    rate = F.least(F.lit(float(most)), F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return d.withColumn("copies", (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with the columns of ``docs``; see plan()."""
    taken = plan(docs, weights, most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
