"""Sinks: files put together from byte ranges, tensor files, plane files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.functions import codecs
from weightloom.runtime import open_fs, ship
from weightloom.sources import safetensors

_WRITTEN = "file_name string, path string, n_bytes long, file_hash string"
_ZEROS = bytes(1 << 16)


def assemble(rows: DataFrame, out: str, partitions: int | None = None) -> DataFrame:
    """Write the files of rows (file_name, size, at, codec, blob, base_codec, base_blob); returns (file_name, path, n_bytes, file_hash).

    A file is written by one task in the order of its places, a chunk at a time, under a temporary name that is changed at
    the end, so a repeated task leaves a whole file. Gaps and what is missing up to `size` are zeros; a chunk beyond it
    or over its predecessor is an error. What is given is lazy: files are written when rows are asked for.
    """
    ship(rows.sparkSession)
    rows = rows.select("file_name", "size", "at", "codec", "blob", "base_codec", "base_blob")
    rows = rows.repartition(partitions, "file_name") if partitions else rows.repartition("file_name")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out)
        now = sink = temporary = total = digest = None
        done = 0

        def put(data: bytes) -> None:
            nonlocal done
            sink.write(data)
            digest.update(data)
            done += len(data)

        def fill(to: int) -> None:
            while done < to:
                put(_ZEROS[: to - done])

        def close() -> pa.RecordBatch:
            fill(total)
            sink.close()
            fs.move(temporary, f"{folder}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{out}/{now}"]), pa.array([done], pa.int64()), pa.array([digest.hexdigest()])], ["file_name", "path", "n_bytes", "file_hash"])

        for b in batches:
            for i in range(len(b)):
                name, size, at, codec, blob, base_codec, base = (b.column(c)[i].as_py() for c in b.schema.names)
                if name != now:
                    if sink is not None:
                        yield close()
                    fs.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                    now, total, done, digest = name, size, 0, xxhash.xxh3_64()
                    temporary = f"{folder}/{name}.{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(temporary, compression=None)
                if at < done:
                    raise ValueError(f"{name}: bytes at {at} are there already")
                fill(at)
                known = None if base is None else codecs.CODECS[base_codec].decode(None, base)
                put(codecs.CODECS[codec].decode(known, blob))
                if done > total:
                    raise ValueError(f"{name}: more than {total} bytes")
        if sink is not None:
            yield close()

    return rows.sortWithinPartitions("file_name", "at").mapInArrow(run, _WRITTEN)


def plain(rows: DataFrame) -> DataFrame:
    """Rows (file_name, size, at, data) as `assemble` takes them."""
    none = F.lit(None)
    return rows.select("file_name", "size", "at", F.lit("raw").alias("codec"), F.col("data").alias("blob"), none.cast("string").alias("base_codec"), none.cast("binary").alias("base_blob"))


def save_tensors(tensors: DataFrame, out: str, partitions: int | None = None) -> DataFrame:
    """Write tensor files from rows (file_name, name, dtype, shape, data), tensors in order of their names.

    A name that a file has twice is an error. Headers are made from names, dtypes, shapes and lengths alone; a file's list
    of these is one value.
    """
    narrow = tensors.select("file_name", F.struct("name", "dtype", "shape", F.octet_length("data").cast("long").alias("n")).alias("t"))
    lists = narrow.groupBy("file_name").agg(F.sort_array(F.collect_list("t")).alias("found"))

    @F.pandas_udf("binary")
    def header(lists: pd.Series) -> pd.Series:
        out = []
        for found in lists:
            rows = [(t["name"], t["dtype"], [int(x) for x in t["shape"]], int(t["n"])) for t in found]
            if len({r[0] for r in rows}) < len(rows):
                raise ValueError("a file has a tensor's name twice")
            out.append(safetensors.header_of(rows))
        return pd.Series(out)

    ship(tensors.sparkSession)
    heads = lists.withColumn("header", header("found"))
    begins = F.transform("found", lambda t, i: F.struct(t["name"].alias("name"), F.aggregate(F.slice("found", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("begin")))
    total = F.octet_length("header") + F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    heads = heads.select("file_name", "header", total.cast("long").alias("size"), begins.alias("begins"))
    places = heads.select("file_name", "size", F.octet_length("header").cast("long").alias("head"), F.explode("begins").alias("b")).select("file_name", "size", F.col("b.name").alias("name"), (F.col("head") + F.col("b.begin")).alias("at"))
    body = tensors.select("file_name", "name", "data").join(places, ["file_name", "name"]).select("file_name", "size", "at", "data")
    return assemble(plain(body.unionByName(heads.select("file_name", "size", F.lit(0).cast("long").alias("at"), F.col("header").alias("data")))), out, partitions)


def combined(tensors: DataFrame, name: str = "combined.safetensors") -> DataFrame:
    """The tensors of all files as one file's: of a name that several have, the last file's."""
    rest = F.max_by(F.struct("dtype", "shape", "data"), F.col("file_name"))
    return tensors.groupBy("name").agg(rest.alias("x")).select(F.lit(name).alias("file_name"), "name", "x.dtype", "x.shape", "x.data")


def write_planes(base: str, tuned: str, out: str) -> dict[str, int]:
    """Two files' planes as four files, plain and compressed, on the driver; returns their sizes. Files without a word are an error."""
    parts = []
    for path in (base, tuned):
        fs, at = open_fs(path)
        with fs.open_input_file(at) as f:
            parts.append(f.read())
    exponents, rest = codecs.planes(*parts)
    fs, folder = open_fs(out)
    fs.create_dir(folder, recursive=True)
    made = {"exp.bin": exponents, "sm.bin": rest, "exp.zst": codecs.compress(exponents), "sm.zst": codecs.compress(rest)}
    for name, data in made.items():
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
            f.write(data)
    return {name: len(data) for name, data in made.items()}


def write_report(spark: SparkSession, rows: DataFrame, path: str, decimals: int = 3) -> None:
    """A report as CSV with a header, doubles with fixed decimals. Reports are small, so it is one file."""
    shown = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
