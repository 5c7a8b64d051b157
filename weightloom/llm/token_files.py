"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Texts are encoded where they are read; what moves is ids of the narrowest unsigned type that holds the vocabulary.
Rows are dealt to parts by ranges of (key, hash of the text), so one key that many rows repeat is split too. The
bounds come from a range partitioning of these two columns alone. Each task writes its part, sorted, as files of
bounded size: ids (`.bin`), and an index (`.idx`: a count, a validity byte, key and offset for each document). Files
have names of their own attempt and yield one manifest row each; only what the manifest names counts, so a
repeated or lost attempt leaves at most an orphan file. A file's base is the prefix sum of the files before it, so
nothing is renumbered. Local files are mapped into memory, others are read by ranges.

Null texts are empty documents (the end id alone); null keys sort first and stay null; any other long is a key. Rows
that repeat a key are documents of their own, in order of their text's hash. A very long text is one document, held
whole while it is encoded. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.llm import subwords
from weightloom.llm.common import open_fs, ship, shuffle_partitions, slices, spread, work_dir

_MANIFEST = "part int, number int, name string, kind string, n_docs long, n_tokens long"
#: Bytes of ids after which a file is closed, and documents whose index is held at a time.
FILE_BYTES, FILE_DOCS, READ_DOCS = 256 << 20, 1 << 20, 4096
_FIRST = -(1 << 63) - 1


def part_bounds(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """The smallest (key, h) of each of up to n ranges but the first; a null key counts as smaller than all."""
    found = rows.select("key", "h").repartitionByRange(n, "key", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key", "h")).alias("x"))
    return sorted((r.x.key if r.x.known else _FIRST, r.x.h) for r in found.collect())[1:]


def write(df: DataFrame, tokenizer: str, out: str | None = None, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> str:
    """Write all texts' ids in ascending key order; returns the folder, with its manifest in `manifest`."""
    spark = df.sparkSession
    ship(spark)
    out, name = out or work_dir(spark, "tokens"), subwords.ship_tokenizer(spark, tokenizer)
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    n = shuffle_partitions(spark)
    bounds = part_bounds(rows, n)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = subwords.encoder(name)
        for whole in batches:
            for b in slices(whole):
                keys, hashes = b.column("key").to_pylist(), b.column("h").to_pylist()
                parts = [bisect_right(bounds, (_FIRST if k is None else k, h)) for k, h in zip(keys, hashes, strict=True)]
                ids = [e.packed(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), b.column("key"), b.column("h"), pa.array(ids, pa.binary())], ["part", "key", "h", "ids"])

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(out)
        kind = subwords.encoder(name).kind
        part, number, data, keys, ends, size = TaskContext.get().partitionId(), 0, None, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, data, keys, ends, size
            data.close()
            known = np.array([k is not None for k in keys], "<u1")
            with fs.open_output_stream(f"{at}/{file}.idx") as f:
                f.write(np.array([len(keys)], "<i8").tobytes() + known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([0, *ends], "<i8").tobytes())
            row = [part, number, file, kind.str, len(keys), size]
            number, data, keys, ends, size = number + 1, None, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "name", "kind", "n_docs", "n_tokens"])

        for b in batches:
            for k, x in zip(b.column("key").to_pylist(), b.column("ids"), strict=True):
                if data is None:
                    fs.create_dir(at, recursive=True)
                    file = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}"
                    data = fs.open_output_stream(f"{at}/{file}.bin")
                raw = x.as_buffer()
                data.write(raw)
                size += raw.size // kind.itemsize
                keys.append(k)
                ends.append(size)
                if size * kind.itemsize >= file_bytes or len(keys) >= FILE_DOCS:
                    yield close()
        if data is not None:
            yield close()

    dealt = spread(rows).mapInArrow(encode, "part int, key long, h long, ids binary").repartitionById(len(bounds) + 1, "part").sortWithinPartitions("key", "h")
    dealt.select("key", "ids").mapInArrow(store, _MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    return out


def files(spark: SparkSession, out: str) -> list[dict]:
    """The manifest in order, one entry per file, with each file's base: the ids of all files before it."""
    rows = sorted(spark.read.schema(_MANIFEST).parquet(f"{out}/manifest").collect(), key=lambda r: (r.part, r.number))
    bases = accumulate((r.n_tokens for r in rows), initial=0)
    return [r.asDict() | {"base": b} for r, b in zip(rows, bases, strict=False)]


class Opened:
    """One file: keys and offsets as arrays, ids by range. A local file is mapped, of others only what is asked for is read."""

    def __init__(self, out: str, name: str, kind: str):
        fs, at = open_fs(out)
        self.kind, self.file = np.dtype(kind), None
        if fs.type_name == "local":
            self.data, index = np.memmap(f"{at}/{name}.bin", self.kind, "r"), np.memmap(f"{at}/{name}.idx", "<u1", "r")
        else:
            self.file = fs.open_input_file(f"{at}/{name}.bin")
            with fs.open_input_file(f"{at}/{name}.idx") as f:
                index = np.frombuffer(f.read(), "<u1")
        n = int(index[:8].view("<i8")[0])
        self.known, body = index[8 : 8 + n].astype(bool), np.frombuffer(index[8 + n :].tobytes(), "<i8")
        self.keys, self.offsets = body[:n], body[n:]

    def ids(self, start: int, end: int) -> np.ndarray:
        if self.file is None:
            return self.data[start:end]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * size, start * size), self.kind)


def read(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32 of the ids widened to 32 bits) of all documents, from the files."""
    ship(spark)
    found = files(spark, out)
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"
    if not found:
        return spark.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, kind, base in zip(b.column("name").to_pylist(), b.column("kind").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = Opened(out, name, kind)
                for at in range(0, len(f.keys), READ_DOCS):
                    end = min(at + READ_DOCS, len(f.keys))
                    offsets = f.offsets[at : end + 1]
                    crc = [zlib.crc32(f.ids(a, e).astype("<u4").tobytes()) for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.keys[at:end], mask=~f.known[at:end], type=pa.int64()), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    plan = spark.createDataFrame([(f["name"], f["kind"], f["base"]) for f in found], "name string, kind string, base long")
    return plan.repartition(min(len(found), shuffle_partitions(spark))).mapInArrow(run, schema)
