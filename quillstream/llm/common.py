"""What the operators of this subpackage share: words, tables, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, \n, \v, \f, \r. Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Written tables that are still there, by path; the scopes that are open, innermost last.
_SCRATCH: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data set in ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The written table survives the loss of executors; a failed write is repeated by Spark's
    committer. It is removed when the scope in which it was written ends (``keep``: the scope
    around that), else by free(), else when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH[path] = spark
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Tables that scratch() writes within are removed at the end, so disk holds one step's alone."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(path)


def free(df: DataFrame) -> None:
    """Remove the table that scratch() wrote for ``df``, when nothing will read it any more."""
    if path := getattr(df, "scratch_path", None):
        _remove(path)


def _remove(path: str) -> None:
    if spark := _SCRATCH.pop(path, None):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path in list(_SCRATCH):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session has ended already
            return


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` if they are ``most`` at most; else the ``most`` that come first by a hash of ``key``, the same ones in each run."""
    n, place = rows.count(), F.pmod(F.xxhash64(key), F.lit(1 << 48))
    if n <= most:
        return rows
    # Enough by hash that ``most`` are among them, but for a chance of some 1e-9; few more go to the sort.
    near = most + 6 * math.sqrt(most) + 16
    return rows.where(place < int(min(1.0, near / n) * (1 << 48))).orderBy(place, key).limit(most)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice has about ``most`` bytes of ``column``, one row at least.

    Whole texts stay whole; this only bounds the memory of vectorised work to a few times ``most``
    or the longest single text.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a slice and the n + 1 offsets of the texts in them; null: empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Stands for a null doc_id while documents are worked on.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text; a null id becomes NO_ID, so that ids are plain numbers in Arrow batches."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string"))


def _digest() -> Column:
    """A text's SHA-256; null: empty."""
    return F.coalesce(F.unhex(F.sha2(F.col("text").cast("string"), 256)), F.lit(b""))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text as by keyed(), but one row, with a number of its own, for every different (doc_id, text).

    Where no two rows have one id, the ids are such numbers, and the second result is None. Otherwise
    doc_id has numbers in the order of ids (null first), and the second result has (key, doc_id,
    digest) of every row of ``docs``. Then texts are shuffled and written once; a test of the ids
    alone decides.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if d.groupBy("doc_id").count().where(f"count > 1 or doc_id = {NO_ID}").isEmpty():
        return keyed(docs), None
    d = d.withColumn("digest", _digest())
    # Rows in order lie in partitions in order, so the numbers increase; writing them makes them last.
    names = d.select("doc_id", "digest").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    names = scratch(names.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("_d"), F.col("digest").alias("_h")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_h"))
    one = d.dropDuplicates(["doc_id", "digest"]).join(names, same).select(F.col("key").alias("doc_id"), "text")
    return scratch(one), scratch(d.select("doc_id", "digest").join(names, same).select("key", "doc_id", "digest"), keep=True)


def of_rows(docs: DataFrame, dropped: DataFrame, names: DataFrame | None) -> DataFrame:
    """The rows of ``docs``, each different (doc_id, text) once, but those whose number by numbered()
    is in ``dropped`` (key).

    Only rows whose id may be a dropped one, by a bit map, meet ``dropped`` in a join: the others'
    texts aren't shuffled. Where ids are shared, all are.
    """
    row = F.struct(*docs.columns).alias("row")
    if names is None:
        d = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"))
        among = id_bits(dropped, "key")
        left = d.where(among(F.col("k"))).join(dropped.select(F.col("key").alias("k")), "k", "left_anti")
        return d.where(~among(F.col("k"))).select("row.*").unionByName(left.select("row.*"))
    d = docs.select(row, F.col("doc_id").cast("long").alias("d"), _digest().alias("h")).dropDuplicates(["d", "h"])
    gone = names.join(dropped.select("key"), "key", "left_semi").select(F.col("doc_id").alias("gd"), F.col("digest").alias("gh")).distinct()
    return d.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("h") == F.col("gh")), "left_anti").select("row.*")


#: Most bits of a map of ids: 4 MB.
MOST_BITS = 1 << 25


def id_bits(rows: DataFrame, *columns: str) -> Callable[[Column], Column]:
    """A test of numbers that is true for all that ``rows`` have in ``columns``, and for some others.

    A bit map of eight bits a number, 4 MB at most whatever their count, is joined by OR on the
    executors. It only spares rows a shuffle: the joins that follow are exact, and where the map is
    full all rows go there. The test is an Arrow UDF that sees hashes of the numbers alone, so other
    columns stay in the JVM.
    """
    ids = rows.select(F.explode(F.array(*columns)).alias("id")).where("id is not null")
    bits = 1 << 14
    n = ids.count()
    while bits < min(8 * n, MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(at / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))").alias("bit"))
    t = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[np.asarray(t.column("word"))] = np.asarray(t.column("bits"))
    b = rows.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def test(place: pa.Array) -> pa.Array:
        x = np.asarray(place)
        return pa.array((b.value[x >> 6] >> (x & 63)) & 1 == 1)

    return lambda c: test(F.pmod(F.xxhash64(c), F.lit(bits)))


def unkeyed(df: DataFrame, *columns: str) -> DataFrame:
    """NO_ID becomes null again in doc_id and the given columns."""
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", *columns)})
