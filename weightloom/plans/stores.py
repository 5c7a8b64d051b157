"""Queries that go through files: vectors as tensor files, ingested, restored, decoded.

A label is a model, label 0 the base of the others; a vector is a tensor of bfloat16 words named after its number within
the model. Files, repository and restored files lie in a work folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weightloom.functions import chunking, codecs
from weightloom.operators import pairing, reports, repository
from weightloom.runtime import ship, work_dir
from weightloom.sinks import files as sinks
from weightloom.sources import safetensors


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (model_id, name, dtype, shape, data)."""

    @F.pandas_udf("binary")
    def words(values: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(v, "<f4").view("<u4") >> 16).astype("<u2").tobytes() for v in values])

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return rows.select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_id"), F.format_string("v%06d", number).alias("name"), F.lit("BF16").alias("dtype"), F.array(F.size("embedding").cast("bigint")).alias("shape"), words("embedding").alias("data"))


def stored(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame]:
    """The folder of files written, the repository that ingested them, and the lineage."""
    base = work_dir(spark, "stores")
    rows = vectors(spark, sf_dir)
    sinks.save_tensors(rows.withColumn("file_name", F.concat("model_id", F.lit("/all.safetensors"))), f"{base}/files").write.parquet(f"{base}/written")
    names = rows.select("model_id").distinct()
    lineage = names.filter("model_id != 'm0'").select(F.lit("m0").alias("base_model_id"), "model_id")
    listed = safetensors.files(spark, f"{base}/files", recursive=True)
    repository.ingest(spark, f"{base}/store", listed, lineage)
    return base, f"{base}/store", lineage


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's tensors, and whether its restored file equals what was ingested."""
    base, store, _ = stored(spark, sf_dir)
    files = repository.restore(spark, store, f"{base}/out").select(F.element_at(F.split("file_name", "/"), 1).alias("model_id"), "exact")
    counts = repository.model_tensors(spark, store).groupBy("model_id").agg(F.count("*").alias("tensors"))
    return counts.join(files, "model_id").join(repository.verified(spark, store), "model_id")


def ingested_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and original bytes by codec."""
    _, store, _ = stored(spark, sf_dir)
    return reports.by_codec(repository.encodings(spark, store)).select("codec", "n", "original")


def header_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places that the headers of the files have, and the bytes found there as a hash."""
    base, _, _ = stored(spark, sf_dir)
    rows = safetensors.tensors(safetensors.files(spark, f"{base}/files", recursive=True, content=True))
    return rows.select("model_id", "name", "dtype", (F.col("end") - F.col("begin")).alias("n_bytes"), F.sha2("data", 256).alias("hash"))


def pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors encoded against their base and decoded: how many are exact."""
    ship(spark)
    rows = vectors(spark, sf_dir)
    base = rows.filter("model_id = 'm0'").drop("model_id")
    both = pairing.pair(rows.filter("model_id != 'm0'"), base, ["dtype", "shape"], order=["data"], carry=["data"]).filter("codec = 'pair'")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [codecs.encode_pair(x, y) for x, y in zip(b.column("base_data").to_pylist(), b.column("data").to_pylist(), strict=True)]
            again = [codecs.decode_pair(x, z) for x, z in zip(b.column("base_data").to_pylist(), blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("data"), pa.array(again, pa.binary())], ["data", "decoded"])

    return reports.exactness(both.select("base_data", "data").mapInArrow(run, "data binary, decoded binary"), "decoded", "data")


def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks of all texts: they cover each text once."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("data"))
    found = chunking.chunks(rows, mean=1024)
    return found.groupBy("doc_id").agg(F.sum("length").alias("n_bytes"), (F.count("*") == F.max("seq") + 1).alias("gapless"), (F.max("length") <= 4096).alias("bounded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (round_trip, ingested_codecs, header_tensors, pair_codec, content_chunks)}

_WORDS = "e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place, len(embedding) AS n, list_transform(embedding, lambda x: ((x::FLOAT::BIT)::INTEGER >> 16) & 65535) AS words FROM embeddings)"
_BYTES = f"{_WORDS}, h AS (SELECT *, from_hex(array_to_string(list_transform(words, lambda w: printf('%02X%02X', w & 255, w >> 8)), '')) AS data FROM e)"
ORACLE_SQL = {
    "round_trip": "SELECT 'm' || label AS model_id, count(*) AS tensors, true AS exact, 'FULLY' AS status FROM embeddings GROUP BY 1",
    "ingested_codecs": f"WITH {_BYTES}, o AS (SELECT DISTINCT data FROM h WHERE label = 0), t AS (SELECT t.data, max(b.data IS NOT NULL) AS paired, max(t.n) AS n FROM h t LEFT JOIN h b ON b.label = 0 AND b.place = t.place AND b.n = t.n WHERE t.label <> 0 AND t.data NOT IN (SELECT data FROM o) GROUP BY 1), a AS (SELECT CASE WHEN paired THEN 'pair' ELSE 'solo' END AS codec, 2 * n AS size FROM t UNION ALL SELECT 'solo', octet_length(data) FROM o) SELECT codec, count(*) AS n, CAST(sum(size) AS BIGINT) AS original FROM a GROUP BY 1",
    "header_tensors": f"WITH {_BYTES} SELECT 'm' || label AS model_id, printf('v%06d', place) AS name, 'BF16' AS dtype, CAST(2 * n AS BIGINT) AS n_bytes, sha256(data) AS hash FROM h",
    "pair_codec": f"WITH {_WORDS} SELECT count(*) AS exact, CAST(0 AS BIGINT) AS different, count(*) AS total FROM e t JOIN e b ON b.label = 0 AND b.place = t.place AND b.n = t.n WHERE t.label <> 0",
    "content_chunks": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS gapless, true AS bounded FROM documents WHERE strlen(text) > 0",
}
