"""Catalog queries over the driver's tables, seen as a model repository, each beside its SQL.

documents are blobs: source is the model, lang the file, doc_id the tensor, text the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.operators import dedup, layers, pairing, reports


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (model_id, file_name, tensor_name, hash, size)."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.col("source").alias("model_id"), F.col("lang").alias("file_name"), F.col("doc_id").alias("tensor_name"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


BLOBS = "b AS (SELECT source AS model_id, lang AS file_name, doc_id AS tensor_name, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents)"
_FIRSTS = f"{BLOBS}, f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY model_id, file_name, tensor_name) > 1 AS is_duplicate FROM b)"


def tensor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.statistics(blobs(spark, sf_dir), "hash", "size")


def dedup_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.marked(blobs(spark, sf_dir), "hash", ["model_id", "file_name", "tensor_name"]).select("tensor_name", "is_duplicate")


def reduction_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.reduction(dedup.marked(blobs(spark, sf_dir), "hash", ["model_id", "file_name", "tensor_name"]), "model_id", "size")


def cumulative_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cumulative(reduction_by_model(spark, sf_dir))


def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.projection(tensor_dedup(spark, sf_dir))


def file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's file is the set of its tensors; its hash is made from theirs without gathering them."""
    return dedup.statistics(reports.file_items(blobs(spark, sf_dir), ["model_id", "file_name"]), "hash", "size")


def layer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of 160 tensors each, named after their number within the model."""
    rows = blobs(spark, sf_dir).withColumn("name", F.format_string("model.layers.%d.mlp.%d", F.expr("tensor_name div 160"), F.expr("tensor_name % 160")))
    return layers.statistics(rows)


def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's least line is the base, all its other lines pair with it where the part's parity is equal."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.sum("l_quantity").alias("size"))
    rows = rows.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("line"), (F.col("part") % 2).alias("dtype"), "size")
    first = rows.groupBy("name").agg(F.min("line").alias("line"))
    base, tuned = rows.join(first, ["name", "line"], "left_semi"), rows.join(first, ["name", "line"], "left_anti")
    return pairing.pair(tuned, base, ["dtype"]).groupBy("codec").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def lineage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    edges = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("base_model_id"), F.col("n_name").alias("model_id"))
    return pairing.base_of(nations.select(F.col("n_name").alias("model_id")).union(regions.select("r_name")), edges)


def codec_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as encodings: the type is the codec, value the compressed size."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy(F.col("event_type").alias("codec")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("compressed"))


def header_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON headers parsed to entries, without metadata."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))
    return rows.filter("name != '__metadata__'").groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tensor_dedup, dedup_marks, reduction_by_model, cumulative_reduction, metadata_projection, file_dedup, layer_dedup, lineage_pairs, lineage_map, codec_statistics, header_entries)}

_STATS = "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS uniques, count(*) / sum(n) AS unique_ratio, max(size) AS max_size, avg(size) AS avg_size, CAST(sum(size) AS BIGINT) AS unique_size, CAST(sum(size * (n - 1)) AS BIGINT) AS saved FROM u"
_REDUCTION = "r AS (SELECT model_id, count(*) AS n, CAST(sum(is_duplicate::INT) AS BIGINT) AS duplicates, CAST(sum(size) AS BIGINT) AS original, CAST(sum(CASE WHEN is_duplicate THEN 0 ELSE size END) AS BIGINT) AS stored FROM f GROUP BY 1)"
ORACLE_SQL = {
    "tensor_dedup": f"WITH {BLOBS}, u AS (SELECT hash, count(*) AS n, max(size) AS size FROM b GROUP BY 1) {_STATS}",
    "dedup_marks": f"WITH {_FIRSTS} SELECT tensor_name, is_duplicate FROM f",
    "reduction_by_model": f"WITH {_FIRSTS}, {_REDUCTION} SELECT *, 1 - stored / original AS reduction FROM r",
    "cumulative_reduction": f"WITH {_FIRSTS}, {_REDUCTION}, c AS (SELECT model_id, CAST(sum(original) OVER w AS BIGINT) AS original, CAST(sum(stored) OVER w AS BIGINT) AS stored FROM r WINDOW w AS (ORDER BY model_id)) SELECT *, 1 - stored / original AS reduction FROM c",
    "metadata_projection": f"WITH {BLOBS}, u AS (SELECT hash, count(*) AS n, max(size) AS size FROM b GROUP BY 1) SELECT count(*) AS uniques, count(*) * 64 / 1048576 AS metadata_mb, count(*) * 64 / 1048576 * (17 * 1024) / 74.79::DOUBLE AS hub_gb FROM u",
    "file_dedup": f"WITH {BLOBS}, g AS (SELECT model_id, file_name, sha256(string_agg(hash, '|' ORDER BY hash)) AS hash, sum(size) AS size FROM b GROUP BY 1, 2), u AS (SELECT hash, count(*) AS n, CAST(max(size) AS BIGINT) AS size FROM g GROUP BY 1) {_STATS}",
    "layer_dedup": f"WITH {BLOBS}, g AS (SELECT model_id, tensor_name // 160 AS layer, sha256(string_agg('mlp.' || (tensor_name % 160) || ':' || hash, '|' ORDER BY 'mlp.' || (tensor_name % 160) || ':' || hash)) AS hash, sum(size) AS size FROM b GROUP BY 1, 2), u AS (SELECT hash, count(*) AS n, CAST(max(size) AS BIGINT) AS size FROM g GROUP BY 1) {_STATS}",
    "lineage_pairs": "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 2 AS dtype, sum(l_quantity) AS size FROM lineitem GROUP BY 1, 2), f AS (SELECT *, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_base FROM l) SELECT CASE WHEN b.dtype = t.dtype THEN 'pair' ELSE 'solo' END AS codec, count(*) AS n, sum(t.size) AS size FROM f t JOIN f b ON b.l_orderkey = t.l_orderkey AND b.is_base WHERE NOT t.is_base GROUP BY 1",
    "lineage_map": "SELECT n_name AS model_id, r_name AS base_model_id FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL FROM region",
    "codec_statistics": "SELECT event_type AS codec, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS compressed FROM events GROUP BY 1",
    "header_entries": "WITH e AS (SELECT unnest(json_keys(props)) AS name, props FROM events) SELECT name, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.' || name) AS BIGINT)) AS BIGINT) AS total FROM e WHERE name <> '__metadata__' GROUP BY 1",
}
