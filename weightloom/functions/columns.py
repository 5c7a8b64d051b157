"""Column functions: model names, sizes as text, throughput as text, ratios, shapes, hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weightloom.functions import codecs
from weightloom.runtime import ship

#: Bytes of an element, by dtype.
WIDTHS = {"F64": 8, "I64": 8, "U64": 8, "F32": 4, "I32": 4, "U32": 4, "F16": 2, "BF16": 2, "I16": 2, "U16": 2, "I8": 1, "U8": 1, "BOOL": 1, "F8_E4M3": 1, "F8_E5M2": 1}


def model_key(name: Column) -> Column:
    """A model's folder name: trimmed, the first slash as an underscore."""
    return F.regexp_replace(F.trim(name), "^([^/]*)/", "$1_")


def model_name(key: Column) -> Column:
    """The name that a folder name stands for if its organisation has no underscore: the first underscore as a slash."""
    return F.regexp_replace(key, "^([^_]*)_", "$1/")


def all_keys(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def size_in_bytes(text: Column) -> Column:
    """Bytes of "512k", "1 mb", "2G" or plain digits; another unit or form is an error. Null stays null."""
    s = F.lower(F.trim(text))
    amount, unit = F.regexp_extract(s, r"^(\d+)\s*([a-z]*)$", 1), F.regexp_extract(s, r"^(\d+)\s*([a-z]*)$", 2)
    power = F.when(unit == "", 0).when(unit.isin("k", "kb"), 10).when(unit.isin("m", "mb"), 20).when(unit.isin("g", "gb"), 30)
    known = F.when(amount != "", F.call_function("shiftleft", amount.cast("bigint"), power))
    return F.when(text.isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("invalid size: "), text)).cast("bigint")))


def throughput(n_bytes: Column, seconds: Column) -> Column:
    """"1.50 GB/s" from 1 GB/s on, else MB/s; "instant" where no time has passed. Halves go to the even digit."""
    mb = F.try_divide(n_bytes / F.lit(1048576.0), seconds)

    def text(x: Column, unit: str) -> Column:
        return F.concat(F.call_function("format_number", x, F.lit("0.00")), F.lit(unit))

    shown = F.when(mb / 1024 >= 1, text(mb / 1024, " GB/s")).otherwise(text(mb, " MB/s"))
    return F.when(seconds <= 0, F.lit("instant")).otherwise(shown)


def reduction(stored: Column, original: Column) -> Column:
    """1 - stored / original; 0 where there is nothing."""
    return F.coalesce(1 - F.try_divide(stored.cast("double"), original.cast("double")), F.lit(0.0))


def ratio(stored: Column, original: Column) -> Column:
    """stored / original; 1 where there is nothing."""
    return F.coalesce(F.try_divide(stored.cast("double"), original.cast("double")), F.lit(1.0))


def elements(shape: Column) -> Column:
    """The product of a shape; 1 for a scalar."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)


def declared_bytes(shape: Column, dtype: Column) -> Column:
    """Bytes that shape and dtype say; null for a dtype that isn't known."""
    widths = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    return elements(shape) * F.try_element_at(widths, dtype)


def content_hash(spark: SparkSession, data: Column) -> Column:
    """XXH3 of binaries as 16 hex digits, in Arrow batches. Null stays null."""
    ship(spark)

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else codecs.content_hash(bytes(v)) for v in values])

    return hashed(data)


def word_planes(base: Column, tuned: Column) -> tuple[Column, Column]:
    """The two planes of 16-bit words given as integers, without Python."""
    x = base.bitwiseXOR(tuned)
    return F.shiftright(x, 7).bitwiseAND(F.lit(255)), F.shiftright(x, 8).bitwiseAND(F.lit(128)).bitwiseOR(x.bitwiseAND(F.lit(127)))
