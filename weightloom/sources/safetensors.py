"""Files of tensors: 64-bit header length, a JSON header, the tensors' bytes.

`files` and `headers` stay inside SQL: listing, length, JSON and checks are column functions, and `binaryFile` reads
whole small files. `headers_by_range` and `chunks` read only what they need of large ones, each task some ranges.
Offsets in a header count from its end. A file that is malformed has one row with an error and no entries.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.functions.codecs import CHUNK
from weightloom.runtime import open_fs, ship

SUFFIX = ".safetensors"
_ENTRY = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"


def files(spark: SparkSession, root: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """Rows (path, file_name, model_id, length[, content]) of a folder's tensor files, or of all below it.

    Empty files aren't listed. model_id: the folder itself, or the first one below it where `recursive`.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(root)
    name = F.element_at(F.split("path", "/"), -1)
    base = root.rstrip("/").split("/")[-1]
    below = F.regexp_extract("path", rf"/\Q{base}\E/([^/]+)/", 1)
    model = F.when(F.lit(recursive) & (below != ""), below).otherwise(F.lit(base))
    return rows.select("path", name.alias("file_name"), model.alias("model_id"), "length", *["content"] * content)


def header_length(content: Column) -> Column:
    """The first 8 bytes as an unsigned little-endian number; null if there are fewer, or from 2^63 on."""
    digits = F.hex(F.substring(content, 1, 8))
    turned = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return F.when(F.octet_length(content) >= 8, F.conv(turned, 16, 10).try_cast("bigint"))


def part(content: Column, start: Column | int, length: Column) -> Column:
    """Bytes from `start`, counted from 0."""
    first = F.lit(start) if isinstance(start, int) else start
    return F.substring(content, (first + 1).cast("int"), length.cast("int"))


def header_bytes(content: Column) -> Column:
    """The header with its length; null if the file is shorter."""
    n = header_length(content)
    return F.when(F.octet_length(content) >= n + 8, part(content, 0, n + 8))


def header_json(content: Column) -> Column:
    """The header's text, metadata included."""
    n = header_length(content)
    return F.when(F.octet_length(content) >= n + 8, part(content, 8, n).cast("string"))


def entries(df: DataFrame) -> DataFrame:
    """The rows of (content, length, ...) with (name, dtype, shape, begin, end, header_size, error); content is dropped.

    A malformed file keeps one row whose error says what is wrong and whose other fields are null.
    """
    others = [c for c in df.columns if c not in ("content", "length")]
    n, text = header_length(F.col("content")), header_json(F.col("content"))
    rows = df.select(*others, "length", (n + 8).alias("header_size"), text.alias("text"), F.from_json(text, _ENTRY, {"mode": "PERMISSIVE"}).alias("found"))
    return checked(rows, others)


def checked(rows: DataFrame, others: list[str]) -> DataFrame:
    """Entries of rows (..., length, header_size, text, found)."""
    given = F.filter(F.map_entries("found"), lambda e: e["key"] != "__metadata__")

    def bad(e: Column) -> Column:
        v = e["value"]
        return v.isNull() | v["dtype"].isNull() | v["shape"].isNull() | (F.coalesce(F.size(v["data_offsets"]), F.lit(0)) != 2)

    def beyond(e: Column) -> Column:
        a, z = e["value"]["data_offsets"][0], e["value"]["data_offsets"][1]
        return (a < 0) | (z < a) | (F.col("header_size") + z > F.col("length"))

    error = F.when(F.col("length") < 8, "no header").when(F.col("header_size").isNull() | (F.col("header_size") > F.col("length")), "header cut short")
    error = error.when(F.col("found").isNull() | F.col("text").isNull() | ~F.trim("text").startswith("{"), "header isn't JSON").when(F.exists(given, bad), "malformed entry").when(F.exists(given, beyond), "offsets beyond the file")
    rows = rows.withColumn("error", error).withColumn("given", F.when(F.col("error").isNull(), given))
    rows = rows.select(*others, "length", "header_size", "error", F.explode_outer("given").alias("e")).filter("error is not null or e is not null")
    offsets = F.col("e.value.data_offsets")
    return rows.select(*others, F.col("e.key").alias("name"), F.col("e.value.dtype").alias("dtype"), F.col("e.value.shape").alias("shape"), F.get(offsets, F.lit(0)).alias("begin"), F.get(offsets, F.lit(1)).alias("end"), F.when(F.col("error").isNull(), F.col("header_size")).alias("header_size"), "error")


def tensors(df: DataFrame) -> DataFrame:
    """Entries with their bytes in `data`, for files read whole. df: (path, content, length, ...)."""
    found = entries(df).filter("error is null")
    body = df.select("path", "content")
    return found.join(body, "path").withColumn("data", part(F.col("content"), F.col("header_size") + F.col("begin"), F.col("end") - F.col("begin"))).drop("content")


def info(df: DataFrame) -> DataFrame:
    """Names, shapes and dtypes alone."""
    return entries(df).filter("error is null").select("path", "name", "shape", "dtype")


def tensor_bytes(df: DataFrame, path: str, name: str) -> DataFrame:
    """The row of one tensor of one file."""
    return tensors(df.filter(F.col("path") == path)).filter(F.col("name") == name)


def file_size(entries: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, file_size): header and largest end offset."""
    return entries.groupBy(*keys).agg((F.max("header_size") + F.max("end")).alias("file_size"))


def headers_by_range(df: DataFrame) -> DataFrame:
    """As `entries`, for rows (path, length, ...) without content: each task reads the headers of its files only."""
    ship(df.sparkSession)
    others = [c for c in df.columns if c not in ("content", "length")]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, texts = [], []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                size = text = None
                if length >= 8:
                    fs, at = open_fs(unquote(path))
                    with fs.open_input_file(at) as f:
                        (n,) = struct.unpack("<Q", f.read_at(8, 0))
                        size = min(n + 8, (1 << 63) - 1)
                        if size <= length:
                            text = f.read_at(n, 8).decode("utf-8", "replace")
                sizes.append(size)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*others, "length")), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], [*others, "length", "header_size", "text"])

    rows = df.select(*others, "length").mapInArrow(run, f"{kinds}, length long, header_size long, text string")
    return checked(rows.withColumn("found", F.from_json("text", _ENTRY, {"mode": "PERMISSIVE"})), others)


def chunks(entries: DataFrame, size: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """The entries with (chunk_no, data): the tensors' bytes in chunks of an even size, read by ranges.

    An empty tensor has one empty chunk. Ranges are dealt over tasks before they are read, so no bytes are shuffled.
    """
    ship(entries.sparkSession)
    step = max(2, size & ~1)
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("begin")) / step)).cast("bigint")
    rows = entries.filter("error is null").withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    rows = rows.repartition(partitions) if partitions else rows
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = file = None
        for b in batches:
            for i in range(len(b)):
                path, head, begin, end, k = (b.column(c)[i].as_py() for c in ("path", "header_size", "begin", "end", "chunk_no"))
                if path != now:
                    if file is not None:
                        file.close()
                    fs, at = open_fs(unquote(path))
                    now, file = path, fs.open_input_file(at)
                first = begin + k * step
                data = file.read_at(max(0, min(step, end - first)), head + first)
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], [*one.schema.names, "data"])

    return rows.mapInArrow(run, f"{kinds}, data binary")


def header_of(found: list[tuple[str, str, list[int], int]], metadata: dict[str, str] | None = None) -> bytes:
    """A header with its length for tensors (name, dtype, shape, bytes) in that order, padded with blanks to 8 bytes."""
    at, entries = 0, {"__metadata__": metadata} if metadata else {}
    for name, dtype, shape, n in found:
        entries[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + n]}
        at += n
    raw = json.dumps(entries, separators=(",", ":")).encode()
    raw += b" " * (-len(raw) % 8)
    return struct.pack("<Q", len(raw)) + raw
