"""Scans of JSON lines, sidecars, images and checksums."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def scan_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, fields that don't fit are null."""
    return spark.read.schema(schema).json(path)


def scan_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The same; a missing file has no rows."""
    return scan_lenient(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file, block (where the task's part of the file begins), and id, which rises by one a line within a block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    return lines.select(*where, F.regexp_replace("value", "\r$", "").alias("value"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file, pos (from 1 in each file) and value.

    Files are split as usual; the lines before a block are a sum over the file's blocks, of which
    there are as many as tasks.
    """
    rows = _placed(spark, path)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("pos"), "value")


def violations(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, problem of lines that are neither blank nor JSON objects."""
    lines = numbered(spark, path).withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    problem = F.when(parsed.isNull(), "not JSON").when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not an object")
    return lines.select("file", "pos", problem.alias("problem")).where("problem is not null")


def scan_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON objects; an error that names file and line where a line isn't one; no rows where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    bad = violations(spark, path).orderBy("file", "pos").first()
    if bad:
        raise ValueError(f"{bad.file}:{bad.pos}: {bad.problem}")
    return spark.read.schema(schema).json(path)


def last_records(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each file that is a JSON object, as text; each block gives its last one, and of these the last block's counts."""
    lines = _placed(spark, path).withColumn("v", F.try_parse_json("value"))
    objects = lines.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    return objects.groupBy("file").agg(F.max_by("value", F.struct("block", "id")).alias("value"))


def scan_sidecars(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One row per JSON file of a folder, with its modification time; broken files are left out."""
    d = spark.read.text(f"{folder}/*.json", wholetext=True)
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE"})
    rows = d.where(F.try_parse_json("value").isNotNull()).select(parsed.alias("r"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("file"))
    return rows.select("r.*", "modified", "file")


def scan_images(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Paths and sizes of image files, distinct and sorted; an error for a path that is neither a folder nor
    an image. Contents are read only if asked for."""
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if "." in name.strip(".") and name.rsplit(".", 1)[1].lower() not in IMAGES and not _is_folder(spark, path):
            raise ValueError(f"not an image: {path}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    found = reader.load(paths).select("path", "length").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    return found.distinct().orderBy("path")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path and SHA-256 of every file under a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines through Spark's committer: readers see all of them or none."""
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, folder: str, name: str, *texts: str, suffixes: tuple[str, ...] = (".txt",)) -> int:
    """A file per row and text column, named by the row's safe name, with the text right-trimmed and one
    line end; the number of files.

    Tasks write through the file system that ``folder`` belongs to, under a name of their own that is
    then renamed, so a task that runs twice leaves the same files. Rows must have different names.
    ``folder`` is one that all executors share.
    """
    from ..functions.text import safe_name

    kept = rows.select(safe_name(F.col(name), "prediction", 200).alias("name"), *(F.concat(F.rtrim(F.coalesce(x, F.lit(""))), F.lit("\n")).alias(f"t{i}") for i, x in enumerate(texts)))
    target = folder.removeprefix("file://").removeprefix("file:")
    if "://" in target:
        raise ValueError("write_texts writes to file systems that are mounted on the executors")

    def write(part: object) -> None:
        os.makedirs(target, exist_ok=True)
        for r in part:
            for i, suffix in enumerate(suffixes):
                _put(os.path.join(target, r["name"] + suffix), r[f"t{i}"])

    kept.foreachPartition(write)
    return kept.count() * len(suffixes)


def _put(path: str, text: str, tries: int = 50, wait: float = 0.02) -> None:
    """Write a file under another name and rename it; where a reader holds it (on some systems), try again, and at last write in place."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    for _ in range(tries):
        try:
            os.replace(part, path)
            return
        except PermissionError:
            time.sleep(wait)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.remove(part)


def write_json(value: dict, path: str) -> None:
    """One JSON object (a summary, a sign that a run is ready), on the driver; readers see all of it or the old one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    _put(path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def append_lines(rows: DataFrame, path: str) -> None:
    """Further JSON lines beside those that are there, committed together."""
    rows.write.mode("append").json(path)


def page_files(spark: SparkSession, texts: str, images: str) -> DataFrame:
    """id, image and target of pages whose text (<folder>/*.txt) and image have one stem; images without text are left out."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1)
    t = spark.read.text(f"{texts}/*.txt", wholetext=True).select(stem.alias("id"), F.col("value").alias("target"))
    i = spark.read.format("binaryFile").load(images).select(F.col("path").alias("image")).where(F.lower(F.regexp_extract("image", r"\.([^./]+)$", 1)).isin(*IMAGES))
    return i.withColumn("id", F.regexp_extract("image", r"([^/]+)\.[^./]*$", 1)).join(t, "id").select("id", "image", "target")


def read_object(spark: SparkSession, path: str, schema: StructType | str) -> dict | None:
    """A file that has one JSON object, as far as ``schema`` names its fields; None where it is missing or isn't one."""
    if not exists(spark, path):
        return None
    kind = schema if isinstance(schema, str) else schema.simpleString()
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("r"), F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")).alias("ok")).first()
    return row.r.asDict(True) if row and row.ok else None


def copy_verified(rows: DataFrame, source: str, target: str, sha256: str) -> DataFrame:
    """Copy each row's file (column ``source`` to column ``target``, on mounted file systems) once per target, check its
    SHA-256 against column ``sha256``, and return target and ``ok``. A copy that is there and right is left."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ok = []
            for a, b, want in zip(part["s"], part["t"], part["h"], strict=True):
                if not (os.path.exists(b) and _digest(b) == want):
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    temporary = f"{b}.{uuid.uuid4().hex}.part"
                    shutil.copyfile(a, temporary)
                    os.replace(temporary, b)
                ok.append(_digest(b) == want)
            yield pd.DataFrame({"target": part["t"], "ok": ok})

    local = lambda c: F.regexp_replace(F.col(c), "^file:(//)?", "")
    one = rows.select(local(source).alias("s"), local(target).alias("t"), F.col(sha256).alias("h")).dropDuplicates(["t"])
    return one.mapInPandas(run, "target string, ok boolean")


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
