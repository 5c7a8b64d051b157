"""A repository of model files: ingest with deduplication and encoding, restore, lookups.

Tables lie below one folder as Parquet, rows are only added, and each carries the number of the ingest that wrote it. An
ingest counts once its row in `commits` is written, last of all; rows of one that failed are never seen, and running it
again starts anew. So a status is a row, and nothing is overwritten.

    commits      (batch)
    models       (model_id, base_model_id, is_processed)
    model_files  (model_id, file_name, file_hash)
    files        (file_hash, size, header, is_processed)
    file_tensors (file_hash, name, tensor_hash, dtype, shape, begin, end)   dtype and shape of each place
    tensors      (hash, name, dtype, shape, original_size)                  one row for each content
    encodings    (hash, chunk_no, at, codec, base_hash, original_size, compressed_size, blob)

Bytes are read by ranges where they are hashed and encoded; only hashes and, for pairs, the base's encoded chunks move.
A content is encoded once and never anew. It is a pair only if no base model holds it, its size is even and not 0, and
its base is stored solo; so decoding needs one other content at most. Equal bytes of a base and a finetuned model are
one content.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.functions import codecs
from weightloom.operators import dedup, pairing, reports
from weightloom.runtime import open_fs, ship, work_dir
from weightloom.sinks import files as sinks
from weightloom.sources import safetensors

TABLES = {
    "commits": "batch string",
    "models": "model_id string, base_model_id string, is_processed boolean, batch string",
    "model_files": "model_id string, file_name string, file_hash string, batch string",
    "files": "file_hash string, size long, header binary, is_processed boolean, batch string",
    "file_tensors": "file_hash string, name string, tensor_hash string, dtype string, shape array<bigint>, begin long, end long, batch string",
    "tensors": "hash string, name string, dtype string, shape array<bigint>, original_size long, batch string",
    "encodings": "hash string, chunk_no long, at long, codec string, base_hash string, original_size long, compressed_size long, blob binary, batch string",
}
#: Bytes read at a time while hashing.
READ = 8 << 20


def table(spark: SparkSession, root: str, name: str, batch: str | None = None) -> DataFrame:
    """The committed rows of a table, and those of an ingest under way; without rows if there is none yet."""
    def rows(of: str) -> DataFrame:
        try:
            return spark.read.schema(TABLES[of]).parquet(f"{root}/{of}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], TABLES[of])

    if name == "commits":
        return rows("commits")
    seen = rows("commits")
    if batch is not None:
        seen = seen.unionByName(spark.createDataFrame([(batch,)], "batch string"))
    return rows(name).join(F.broadcast(seen), "batch", "left_semi").drop("batch")


def hashed_files(files: DataFrame) -> DataFrame:
    """The rows of (path, length, ...) with file_hash and header bytes (null if malformed), read in blocks."""
    ship(files.sparkSession)
    kinds = ", ".join(f"`{c}` {k}" for c, k in files.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, headers = [], []
            for path in b.column("path").to_pylist():
                fs, at = open_fs(unquote(path))
                digest, size = xxhash.xxh3_64(), fs.get_file_info(at).size
                with fs.open_input_file(at) as f:
                    start = f.read_at(min(8, size), 0)
                    n = int.from_bytes(start, "little") + 8
                    headers.append(f.read_at(n, 0) if len(start) == 8 and n <= size else None)
                    for lo in range(0, size, READ):
                        digest.update(f.read_at(min(READ, size - lo), lo))
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes), pa.array(headers, pa.binary())], [*b.schema.names, "file_hash", "header"])

    return files.mapInArrow(run, f"{kinds}, file_hash string, header binary")


def hashed_tensors(entries: DataFrame) -> DataFrame:
    """The entries with tensor_hash; a tensor is read in blocks by one task."""
    ship(entries.sparkSession)
    kinds = ", ".join(f"`{c}` {k}" for c, k in entries.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, head, begin, end in zip(*(b.column(c).to_pylist() for c in ("path", "header_size", "begin", "end")), strict=True):
                fs, at = open_fs(unquote(path))
                digest = xxhash.xxh3_64()
                with fs.open_input_file(at) as f:
                    for lo in range(head + begin, head + end, READ):
                        digest.update(f.read_at(min(READ, head + end - lo), lo))
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "tensor_hash"])

    return entries.mapInArrow(run, f"{kinds}, tensor_hash string")


def encoded(chunks: DataFrame) -> DataFrame:
    """Rows of `encodings` for chunks (hash, chunk_no, at, codec, base_hash, data, base_blob)."""
    ship(chunks.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                codec, data, base = (row.column(c)[0].as_py() for c in ("codec", "data", "base_blob"))
                known = None if base is None else codecs.CODECS["solo"].decode(None, base)
                blob = codecs.CODECS[codec].encode(known, data)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("hash", "chunk_no", "at", "codec", "base_hash")), pa.array([len(data)], pa.int64()), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["hash", "chunk_no", "at", "codec", "base_hash", "original_size", "compressed_size", "blob"])

    return chunks.select("hash", "chunk_no", "at", "codec", "base_hash", "data", "base_blob").mapInArrow(run, TABLES["encodings"].removesuffix(", batch string"))


def model_tensors(spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
    """Rows (model_id, file_name, name, hash, dtype, shape, begin, size): every tensor of every model."""
    found = table(spark, root, "model_files", batch).join(table(spark, root, "file_tensors", batch), "file_hash")
    return found.select("model_id", "file_name", "name", F.col("tensor_hash").alias("hash"), "dtype", "shape", "begin", (F.col("end") - F.col("begin")).alias("size"))


def choices(new: DataFrame, places: DataFrame, lineage: DataFrame, solo: DataFrame) -> DataFrame:
    """Rows (hash, codec, base_hash) for new contents. places: as model_tensors; solo: hashes stored solo already."""
    models = pairing.base_of(places.select("model_id").distinct(), lineage)
    rooted = places.join(models, "model_id")
    ours = rooted.filter("base_model_id is null").select("hash").distinct()
    tuned = rooted.filter("base_model_id is not null").join(new.select("hash"), "hash").join(ours, "hash", "left_anti")
    tuned = tuned.select("hash", "file_name", "begin", "model_id", "dtype", "shape", "size", F.struct(F.col("base_model_id").alias("model_id"), "name").alias("name"))
    base = places.select(F.struct("model_id", "name").alias("name"), "dtype", "shape", "size", "hash", "file_name", "begin")
    paired = pairing.pair(tuned, base, ["dtype", "shape", "size"], order=["file_name", "begin"], carry=["hash"]).filter("codec = 'pair' and size >= 2 and size % 2 = 0")
    stored = solo.select("hash").union(ours.join(new.select("hash"), "hash", "left_semi")).distinct().select(F.col("hash").alias("base_hash"))
    paired = paired.join(stored, "base_hash", "left_semi").groupBy("hash").agg(F.min_by("base_hash", F.struct("model_id", "file_name", "begin")).alias("base_hash"))
    return new.select("hash").join(paired, "hash", "left").select("hash", F.when(F.col("base_hash").isNotNull(), "pair").otherwise("solo").alias("codec"), "base_hash")


def ingest(spark: SparkSession, root: str, files: DataFrame, lineage: DataFrame, chunk: int = codecs.CHUNK, partitions: int | None = None, again: bool = False) -> str | None:
    """Add the models of files (model_id, file_name, path, length); lineage: (base_model_id, model_id). Returns the batch, or None if all were there.

    Models that are processed are left alone, or with `again` only those of their files that are known by name; of files and tensors only contents that aren't known are read on. A base and
    its finetuned models may come in any order and in one call. A malformed file fails the whole call.
    """
    batch, work = uuid.uuid4().hex, work_dir(spark, "ingest")
    done = table(spark, root, "model_files") if again else table(spark, root, "models").filter("is_processed")
    left = dedup.processed_stay(files.select("model_id", "file_name", "path", "length"), done, ["model_id", "file_name"] if again else ["model_id"])

    def stage(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    def add(rows: DataFrame, name: str) -> None:
        rows.withColumn("batch", F.lit(batch)).select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("append").parquet(f"{root}/{name}")

    read = stage(hashed_files(left.repartition(partitions) if partitions else left), "files")
    if read.isEmpty():
        return None
    known = table(spark, root, "files").filter("is_processed")
    fresh = stage(dedup.unseen(read, known, "file_hash", ["model_id", "file_name"]), "fresh")
    entries = stage(safetensors.headers_by_range(fresh.select("path", "length", "file_hash", "model_id", "file_name")), "entries")
    bad = entries.filter("error is not null").select("path", "error").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.path}: {r.error}" for r in bad))
    found = stage(hashed_tensors(entries.repartition(partitions) if partitions else entries), "tensors")
    add(read.select("model_id", "file_name", "file_hash"), "model_files")
    add(fresh.select("file_hash", F.col("length").alias("size"), "header", F.lit(True).alias("is_processed")), "files")
    add(found.select("file_hash", "name", "tensor_hash", "dtype", "shape", "begin", "end"), "file_tensors")

    places = model_tensors(spark, root, batch)
    order = ["model_id", "file_name", "begin", "name"]
    rows = found.select(F.col("tensor_hash").alias("hash"), *order, "dtype", "shape", "path", "header_size", "end", "error")
    new = stage(dedup.unseen(rows, table(spark, root, "tensors"), "hash", order), "new")
    heads = table(spark, root, "encodings").filter("chunk_no = 0 and codec = 'solo'")
    plan = stage(new.join(choices(new, places, lineage, heads), "hash"), "plan")
    none = F.lit(None).cast("binary").alias("base_blob")
    at = (F.col("chunk_no") * max(2, chunk & ~1)).alias("at")
    solos = safetensors.chunks(plan.filter("codec = 'solo'"), chunk, partitions)
    add(encoded(solos.select("hash", "chunk_no", at, "codec", "base_hash", "data", none)), "encodings")
    pairs = plan.filter("codec = 'pair'")
    bases = table(spark, root, "encodings", batch).select(F.col("hash").alias("base_hash"), F.col("chunk_no").alias("base_no"), F.col("at").alias("base_at"), F.col("original_size").alias("base_size"), F.col("blob").alias("base_blob"))
    # A pair's chunks are those that its base was stored in, so each meets one encoded chunk.
    first = F.col("begin") + F.col("base_at")
    pairs = pairs.join(bases, "base_hash").withColumns({"begin": first, "end": first + F.col("base_size")})
    ranged = safetensors.chunks(pairs, 1 << 40)
    add(encoded(ranged.select("hash", F.col("base_no").alias("chunk_no"), F.col("base_at").alias("at"), "codec", "base_hash", "data", "base_blob")), "encodings")
    add(new.select("hash", "name", "dtype", "shape", (F.col("end") - F.col("begin")).alias("original_size")), "tensors")
    models = pairing.base_of(read.select("model_id").distinct(), lineage)
    add(models.withColumn("is_processed", F.lit(True)), "models")
    add(spark.range(1).select(F.lit(batch).alias("batch")).select("batch"), "commits")
    return batch


def encodings(spark: SparkSession, root: str) -> DataFrame:
    """Rows (hash, codec, base_hash, original_size, compressed_size): one for each content, without its bytes."""
    rows = table(spark, root, "encodings").groupBy("hash", "codec", "base_hash")
    return rows.agg(F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"))


def restore_chunks(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """Rows for `sinks.files.assemble`: the chunks and headers of the files of some models, or of all."""
    mine = table(spark, root, "model_files")
    if models is not None:
        mine = mine.filter(F.col("model_id").isin(models))
    out = F.concat_ws("/", "model_id", "file_name").alias("file_name")
    files = mine.join(table(spark, root, "files"), "file_hash").select(out, "file_hash", "size", "header")
    none = F.lit(None)
    heads = files.select("file_name", "size", F.lit(0).cast("long").alias("at"), F.lit("raw").alias("codec"), F.col("header").alias("blob"), none.cast("string").alias("base_codec"), none.cast("binary").alias("base_blob"))
    entries = files.select("file_name", "file_hash", "size", F.octet_length("header").alias("head")).join(table(spark, root, "file_tensors"), "file_hash")
    all_blobs = table(spark, root, "encodings").select("hash", "at", "codec", "base_hash", "blob")
    blobs = all_blobs.alias("e").join(all_blobs.filter("codec = 'solo'").alias("b"), F.expr("e.base_hash = b.hash and e.at = b.at"), "left")
    blobs = blobs.select(F.col("e.hash").alias("tensor_hash"), F.col("e.at").alias("at"), F.col("e.codec").alias("codec"), F.col("e.blob").alias("blob"), F.col("b.codec").alias("base_codec"), F.col("b.blob").alias("base_blob"))
    body = entries.filter("end > begin").join(blobs, "tensor_hash", "left")
    at = (F.col("head") + F.col("begin") + F.coalesce("at", F.raise_error(F.concat(F.lit("no encoding for "), "tensor_hash")).cast("long"))).alias("at")
    return heads.unionByName(body.select("file_name", "size", at, "codec", "blob", "base_codec", "base_blob"))


def restore(spark: SparkSession, root: str, out: str, models: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Write the files of some models, or of all, below `out` as <model>/<file>; returns (file_name, path, n_bytes, file_hash, exact).

    exact: whether the hash of what was written is the file's. An unknown model is an error.
    """
    known = table(spark, root, "model_files").select("model_id").distinct()
    if models is not None:
        missing = set(models) - {r.model_id for r in known.filter(F.col("model_id").isin(models)).collect()}
        if missing:
            raise ValueError(f"unknown models: {', '.join(sorted(missing))}")
    report = work_dir(spark, "restored")
    sinks.assemble(restore_chunks(spark, root, models), out, partitions).write.parquet(report)
    written = spark.read.schema("file_name string, path string, n_bytes long, file_hash string").parquet(report)
    wanted = table(spark, root, "model_files").select(F.concat_ws("/", "model_id", "file_name").alias("file_name"), F.col("file_hash").alias("wanted"))
    return written.join(wanted, "file_name").withColumn("exact", F.col("file_hash") == F.col("wanted")).drop("wanted")


def restore_plan(places: DataFrame, encodings: DataFrame, model: str) -> DataFrame:
    """One row for a model: tensors, contents to load, of these bases, and contents by codec. places: (model_id, hash)."""
    mine = places.filter(F.col("model_id") == model)
    loads = mine.select("hash").distinct().join(encodings.select("hash", "codec", "base_hash"), "hash", "left")
    bases = loads.filter("base_hash is not null").select(F.col("base_hash").alias("hash")).distinct()
    counts = [mine.select(F.lit("tensor").alias("kind")), loads.select(F.coalesce("codec", F.lit("missing")).alias("kind"))]
    rows = counts[0].union(counts[1]).union(loads.select("hash").union(bases).distinct().select(F.lit("load")))
    names = {"tensors": "tensor", "unique_loads": "load", "pairs": "pair", "solos": "solo", "missing": "missing"}
    return rows.agg(*[F.count_if(F.col("kind") == kind).alias(name) for name, kind in names.items()])


def lookup(spark: SparkSession, root: str, name: str, **keys: str) -> DataFrame:
    """The rows of a table with these values."""
    rows = table(spark, root, name)
    for column, value in keys.items():
        rows = rows.filter(F.col(column) == value)
    return rows


def exists(spark: SparkSession, root: str, name: str, **keys: str) -> bool:
    return not lookup(spark, root, name, **keys).isEmpty()


def verified(spark: SparkSession, root: str) -> DataFrame:
    """FULLY or PARTIALLY for each model: whether it and all its files are processed."""
    files = table(spark, root, "model_files").join(table(spark, root, "files").select("file_hash", "is_processed"), "file_hash", "left")
    models = table(spark, root, "models").select("model_id", "is_processed")
    return reports.status(files.select("model_id", "is_processed").unionByName(models))
