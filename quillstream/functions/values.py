"""Expressions over single values: boxes, numbers, JSON, fingerprints, scale specifications."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .binding import let


def bbox(values: Column, *edges: Column) -> Column:
    """(x0, y0, x1, y1) from the first four of an array, or from four columns where that has fewer;
    null if one isn't a number or the box has no area."""
    parts = F.when(F.size(values) >= 4, F.slice(values, 1, 4)).otherwise(F.array(*(e.cast("string") for e in edges)) if edges else F.lit(None))
    numbers = F.transform(parts, lambda v: v.try_cast("double"))

    def box(n: Column) -> Column:
        x0, y0, x1, y1 = (F.get(n, F.lit(k)) for k in range(4))
        return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))

    return F.when(F.forall(numbers, lambda n: n.isNotNull() & ~F.isnan(n)), let(numbers, box))


def finite(number: Column) -> Column:
    """A number, or null where it is infinite or not a number."""
    x = number.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clamp(number: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), number))


@pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys and without spaces, other letters than ASCII as they are (an Arrow UDF); null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return values.map(one)


def canonical_hash(value: Column) -> Column:
    """The SHA-256 of canonical_json()."""
    return F.sha2(canonical_json(value), 256)


def object_hash(fields: dict[str, Column]) -> Column:
    """canonical_hash() of an object whose fields are known, without Python: keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def iso_utc(ts: Column) -> Column:
    """A time as ISO 8601 text in UTC with microseconds (the session's time zone being UTC)."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def source_fingerprint(path: Column, size: Column, modified_ns: Column) -> Column:
    """Ten hexadecimal digits that change with a file's path, size or time."""
    return F.left(F.sha2(F.concat_ws("|", path, size.cast("string"), modified_ns.cast("string")), 256), F.lit(10))


def layer_scales(specs: Column, layers: int = 36) -> Column:
    """From an array of FIRST-LAST:SCALE or LAYER:SCALE, (layer, scale) of each named layer, in order; an
    error for another form, a layer out of range, or one that is named twice."""
    field = lambda s, k: F.regexp_extract(F.trim(s), r"^(\d+)(?:-(\d+))?:(\d+(?:\.\d+)?)$", k)

    def of(s: Column) -> Column:
        first = field(s, 1).try_cast("int")
        last = F.coalesce(field(s, 2).try_cast("int"), first)
        ok = first.isNotNull() & (first <= last) & (last < layers)
        scale = field(s, 3).try_cast("double")
        return F.when(ok, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("layer"), scale.alias("scale"))))

    found = F.transform(specs, of)
    bad = F.exists(found, lambda x: x.isNull())
    all_ = F.flatten(found)
    twice = F.size(F.array_distinct(F.transform(all_, lambda x: x["layer"]))) < F.size(all_)
    wrong = F.raise_error(F.concat(F.lit("invalid or repeated layer scale: "), F.array_join(specs, " "))).cast("array<struct<layer:int,scale:double>>")
    return F.when(bad, wrong).when(twice, wrong).otherwise(F.array_sort(all_))


def part_scales(specs: Column, parts: str = "[a-z_]+", layers: int = 36) -> Column:
    """From an array of LAYER:PART:SCALE, (layer, part, scale), in order; an error as in layer_scales().
    ``parts`` says what a part looks like: a projection's name, or digits for a head."""
    pattern = rf"^(\d+):({parts}):(\d+(?:\.\d+)?)$"
    field = lambda s, k: F.regexp_extract(F.trim(s), pattern, k)
    found = F.transform(specs, lambda s: F.struct(field(s, 1).try_cast("int").alias("layer"), field(s, 2).alias("part"), field(s, 3).try_cast("double").alias("scale")))
    bad = F.exists(found, lambda x: x["layer"].isNull() | (x["layer"] >= layers))
    twice = F.size(F.array_distinct(F.transform(found, lambda x: F.struct(x["layer"], x["part"])))) < F.size(found)
    wrong = F.raise_error(F.concat(F.lit("invalid or repeated scale: "), F.array_join(specs, " "))).cast("array<struct<layer:int,part:string,scale:double>>")
    return F.when(bad | twice, wrong).otherwise(F.array_sort(found))
