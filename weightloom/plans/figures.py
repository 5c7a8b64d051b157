"""Queries of pairing, codecs, curves and reports over the driver's tables, each beside its SQL.

lineitem: an order is a model's layer, its least line number the base, its other lines finetuned tensors; l_partkey holds
the bytes, l_suppkey modulo 2 the dtype. A line's encoded size is a stand-in, as SQL has no zstd. events: a record is a
benchmark run. documents: a source is a model, a line of text a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.functions import columns
from weightloom.operators import dedup, pairing, reports
from weightloom.plans.catalog import BLOBS, blobs
from weightloom.sources import lists


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (name, line, part, dtype, size) of lineitem, those of an order's least line number marked as base."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 2).alias("dtype"), F.col("l_quantity").cast("bigint").alias("size"))
    least = rows.groupBy("name").agg(F.min("line").alias("least"))
    return rows.join(least, "name").withColumn("is_base", F.col("line") == F.col("least")).drop("least")


_LINES = "l AS (SELECT l_orderkey AS name, l_linenumber AS line, l_partkey AS part, l_suppkey % 2 AS dtype, CAST(l_quantity AS BIGINT) AS size, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_base FROM lineitem)"
_BASES = "b AS (SELECT name, dtype, part, row_number() OVER (PARTITION BY name ORDER BY dtype DESC, part DESC) AS place FROM l WHERE is_base)"
_PAIRED = f"{_LINES}, {_BASES}, p AS (SELECT t.*, CASE WHEN b.dtype = t.dtype THEN 'pair' ELSE 'solo' END AS codec, CASE WHEN b.dtype = t.dtype THEN b.part END AS base_part FROM l t LEFT JOIN b ON b.name = t.name AND b.place = 1 WHERE NOT t.is_base)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finetuned lines with codec and the base's part."""
    rows = lines(spark, sf_dir)
    base = rows.filter("is_base").select("name", "dtype", "part")
    return pairing.pair(rows.filter("not is_base").drop("is_base"), base, ["dtype"], order=["dtype", "part"], carry=["part"])


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sizes: a pair is encoded to a third, a solo to half."""
    rows = paired(spark, sf_dir).withColumn("original_size", F.col("size"))
    return rows.withColumn("compressed_size", F.expr("CASE WHEN codec = 'pair' THEN size div 3 ELSE size div 2 END"))


_SIZED = f"{_PAIRED}, s AS (SELECT *, size AS original_size, CASE WHEN codec = 'pair' THEN size // 3 ELSE size // 2 END AS compressed_size FROM p)"


def pair_or_solo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).groupBy("codec").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count("base_part").alias("with_base"))


def compression_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compression(sized(spark, sf_dir))


def codec_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_codec(sized(spark, sf_dir))


def benchmark_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.benchmark(sized(spark, sf_dir), F.lit(2.0))


def planes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value of the two planes occurs in pairs of parts."""
    low = (F.col("base_part").bitwiseAND(F.lit(65535)), F.col("part").bitwiseAND(F.lit(65535)))
    exponent, rest = columns.word_planes(*low)
    rows = paired(spark, sf_dir).filter("codec = 'pair'").select(exponent.alias("exponent"), rest.alias("rest"))
    return rows.groupBy("exponent", "rest").agg(F.count("*").alias("n"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (model_id, vec_id, place, word): a vector's floats as bfloat16 words."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), "vec_id", F.posexplode("embedding").alias("place", "x"))
    bits = F.call_function("java_method", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), F.col("x")).cast("int")
    return rows.select("model_id", "vec_id", "place", F.shiftright(bits, 16).bitwiseAND(F.lit(65535)).cast("int").alias("word"))


_WORDS = "e AS (SELECT label AS model_id, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), w AS (SELECT model_id, vec_id, place, ((x::FLOAT::BIT)::INTEGER >> 16) & 65535 AS word FROM e)"
_PLACED = f"{_WORDS}, r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS name FROM embeddings), n AS (SELECT w.model_id, r.name, w.place, w.word FROM w JOIN r USING (vec_id))"


def plane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponent plane of each finetuned vector against the base model's vector of the same number."""
    from pyspark.sql import Window

    numbers = read(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("name"))
    rows = words(spark, sf_dir).join(numbers.drop("model_id"), "vec_id")
    base = rows.filter("model_id = 0").select("name", "place", F.col("word").alias("base"))
    both = rows.filter("model_id != 0").join(base, ["name", "place"])
    exponent, _ = columns.word_planes(F.col("base"), F.col("word"))
    return both.groupBy("model_id", exponent.cast("int").alias("exponent")).agg(F.count("*").alias("n"))


def plane_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that the exponent plane of each model's own words needs at least."""
    exponent, _ = columns.word_planes(F.lit(0), F.col("word"))
    counts = words(spark, sf_dir).groupBy("model_id", exponent.alias("exponent")).agg(F.count("*").alias("n"))
    total = counts.groupBy("model_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return total.select("model_id", "total", F.round(F.col("total") * F.log2("total") - F.col("x"), 6).alias("bits"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (model_id, digest, length): the lines of a source's texts as chunks."""
    text = F.explode(F.split("text", "\n")).alias("chunk")
    return read(spark, sf_dir, "documents").select(F.col("source").alias("model_id"), text).select("model_id", F.sha2("chunk", 256).alias("digest"), F.octet_length("chunk").cast("bigint").alias("length"))


_CHUNKS = "k AS (SELECT source AS model_id, unnest(string_split(text, chr(10))) AS chunk FROM documents), c AS (SELECT model_id, sha256(chunk) AS digest, CAST(strlen(chunk) AS BIGINT) AS length FROM k)"
_CURVE = "SELECT model_id, CAST(sum(original) OVER w AS BIGINT) AS original, CAST(sum(stored) OVER w AS BIGINT) AS stored, 1 - sum(stored) OVER w / sum(original) OVER w AS reduction FROM g WINDOW w AS (ORDER BY model_id)"


def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.statistics(chunk_rows(spark, sf_dir), "digest", "length")


def chunk_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_curve(chunk_rows(spark, sf_dir))


def chunk_curve_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_curve(chunk_rows(spark, sf_dir), repeats_in_first=False)


def tensor_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of up to 100 bytes have no encoding, others one of a third of their size."""
    rows = blobs(spark, sf_dir)
    encodings = rows.filter("size > 100").groupBy("hash").agg(F.max(F.expr("size div 3")).alias("compressed_size"))
    return reports.tensor_curve(rows, rows, encodings)


def codec_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blobs(spark, sf_dir)
    return reports.codec_curve(rows.select("model_id", F.col("size").alias("original_size"), F.expr("size div 2").alias("compressed_size")))


def dedup_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources from src15 on add to those before."""
    rows = blobs(spark, sf_dir)
    order = ["model_id", "file_name", "tensor_name"]
    new = dedup.unseen(rows.filter("model_id >= 'src15'"), rows.filter("model_id < 'src15'"), "hash", order)
    return new.select("hash", *order, "size")


def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What restoring the finetuned lines of every order loads: places, contents, contents with those of bases."""
    rows = paired(spark, sf_dir)
    content = rows.select(F.col("part").alias("hash")).distinct()
    loads = content.union(rows.filter("base_part is not null").select("base_part")).distinct()
    kinds = rows.select(F.lit("place").alias("kind")).union(content.select(F.lit("content"))).union(loads.select(F.lit("load")))
    return kinds.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("place", "content", "load")])


def model_tensor_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, their files, the files' tensors and each content's first description, joined."""
    rows = blobs(spark, sf_dir)
    files = rows.select("model_id", "file_name").distinct().withColumn("file_hash", F.concat_ws("/", "model_id", "file_name"))
    tensors = rows.select(F.concat_ws("/", "model_id", "file_name").alias("file_hash"), F.col("tensor_name").alias("name"), "hash")
    described = dedup.firsts(rows, "hash", ["tensor_name", "size"]).select(F.col("digest").alias("hash"), F.col("first.tensor_name").alias("described"), F.col("first.size").alias("size"))
    found = files.join(tensors, "file_hash").join(described, "hash")
    return found.select("model_id", "file_name", "name", "described", "size")


def verify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as models, orders as files, which are processed where their status is F."""
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("model_id"), (F.col("o_orderstatus") != "P").alias("is_processed"))
    return reports.status(rows)


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a model list: the first blank stands for the slash."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/"), "p_name").alias("value"))
    found = lists.model_list(rows)
    return found.select("p_partkey", "model_id", "key", columns.model_name(F.col("key")).alias("name"), columns.all_keys(F.col("model_id")).alias("all_keys"))


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(p_size, element_at(array('', 'k', ' KB', 'm', 'Mb', 'g', ' gb '), cast(p_partkey % 7 as int) + 1))")
    return read(spark, sf_dir, "part").select("p_partkey", columns.size_in_bytes(text).alias("n_bytes"))


def throughput_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1048576).alias("n"), F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 7).cast("double")).otherwise(0.0).alias("s"))
    return rows.select("o_orderkey", columns.throughput(F.col("n"), F.col("s")).alias("throughput"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (threads, throughput, verification): events as runs."""
    n = F.call_function("shiftleft", F.lit(1), (F.col("user_id") % 5).cast("int")).alias("threads")
    ok = F.when(F.col("event_id") % 997 == 5, "FAIL").when(F.col("user_id") % 5 == 2, "UNKNOWN").otherwise("PASS").alias("verification")
    return read(spark, sf_dir, "events").select(n, (F.col("event_id") % 100).alias("throughput"), ok)


_RUNS = "r AS (SELECT 1 << CAST(user_id % 5 AS INTEGER) AS threads, event_id % 100 AS throughput, CASE WHEN event_id % 997 = 5 THEN 'FAIL' WHEN user_id % 5 = 2 THEN 'UNKNOWN' ELSE 'PASS' END AS verification FROM events)"
_THREADS = f"{_RUNS}, t AS (SELECT threads, avg(throughput) AS avg_throughput, min(throughput) AS min_throughput, max(throughput) AS max_throughput, count(*) AS num_records FROM r GROUP BY 1)"


def verification_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verification(runs(spark, sf_dir))


def throughput_by_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.throughput(runs(spark, sf_dir))


def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.speedup(reports.throughput(runs(spark, sf_dir)))
    return rows.select("threads", F.round("speedup", 9).alias("speedup"), F.round("efficiency", 9).alias("efficiency"))


def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extremes(reports.throughput(runs(spark, sf_dir)))


def download_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two lists who have no order yet."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), "c_acctbal", "c_mktsegment")
    return pairing.wanted([customers.filter("c_acctbal > 1000"), customers.filter("c_mktsegment = 'BUILDING'")], read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model_id")))


def results_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages without a text of quality 1: files whose result isn't there yet."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model_id"), F.col("lang").alias("file_name"))
    done = rows.join(read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id")
    return dedup.processed_stay(rows, done, ["model_id", "file_name"]).groupBy("model_id", "file_name").agg(F.count("*").alias("n"))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.concat_ws("Q", F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")).alias("quarter"), F.col("o_totalprice").cast("bigint").alias("size"))
    return reports.growth(rows)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of digest and length, some with a field too few or too many, read as a chunk list."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 5 WHEN 0 THEN cast(o_orderkey as string) WHEN 1 THEN concat(o_orderkey, ' ', o_custkey, ' x') ELSE concat(' ', o_orderkey, '  ', o_custkey) END").alias("value"))
    return lists.chunk_list(rows)


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("start\nThroughput: "), F.col("event_id").cast("string"), F.lit(".5 MB/s\nCompression time: "), F.col("user_id").cast("string"), F.lit(" seconds\n"), F.when(F.col("event_id") % 3 == 0, "All tensors passed bit-exact verification").when(F.col("event_id") % 3 == 1, "WARNING: 2 tensors failed bit-exact verification").otherwise(""))
    rows = lists.log_fields(read(spark, sf_dir, "events").select("event_id", text.alias("value")))
    return rows.select("event_id", "compression_throughput", "compression_time", "compression_ratio", "verification", "success")


def lineage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage written as JSON and read again."""
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    edges = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("base_model_id"), F.col("n_name").alias("model_id"))
    return lists.read_lineage(lists.lineage_json(edges))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files with a header of 100 bytes, lines as tensors that end where their price says."""
    from weightloom.sources import safetensors

    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit(100).cast("bigint").alias("header_size"), F.floor("l_extendedprice").cast("bigint").alias("end"))
    return safetensors.file_size(rows, "file")


def name_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of a part, the last by order and line: a name that several files have."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("hash"))
    return pairing.latest(rows, ["name"], ["file", "line", "hash"])


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by XXH3: as many contents as texts, of the same sizes."""
    rows = read(spark, sf_dir, "documents").filter("text is not null").select(columns.content_hash(spark, F.col("text").cast("binary")).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))
    return dedup.statistics(rows, "hash", "size").select("total", "uniques", "unique_size", "saved")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (pair_or_solo, compression_statistics, codec_histogram, benchmark_fold, planes_lineitem, plane_histogram, plane_entropy, chunk_dedup, chunk_curve, chunk_curve_once, tensor_curve, codec_curve, dedup_increment, restore_plan, model_tensor_info, verify_status, model_names, size_texts, throughput_texts, verification_fold, throughput_by_threads, speedup, best_and_worst, download_set, results_skip, growth, chunk_lines, log_fields, lineage_lists, file_sizes, name_latest, content_hashes)}

_STATS = "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS uniques, count(*) / sum(n) AS unique_ratio, max(size) AS max_size, avg(size) AS avg_size, CAST(sum(size) AS BIGINT) AS unique_size, CAST(sum(size * (n - 1)) AS BIGINT) AS saved FROM u"
_CHUNK_GROUPS = "y AS (SELECT model_id, digest, sum(length) AS total, max(length) AS once FROM c GROUP BY 1, 2), z AS (SELECT *, min(model_id) OVER (PARTITION BY digest) AS first FROM y), g AS (SELECT model_id, sum(total) AS original, sum(CASE WHEN model_id = first THEN {} ELSE 0 END) AS stored FROM z GROUP BY 1)"
ORACLE_SQL = {
    "pair_or_solo": f"WITH {_PAIRED} SELECT codec, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, count(base_part) AS with_base FROM p GROUP BY 1",
    "compression_statistics": f"WITH {_SIZED} SELECT CAST(sum(CASE WHEN codec = 'pair' THEN 2 ELSE 1 END) AS BIGINT) AS total, 2 * count(*) FILTER (codec = 'pair') AS paired, count(*) FILTER (codec <> 'pair') AS solo, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, CAST(sum(compressed_size) AS DOUBLE) / CAST(sum(original_size) AS DOUBLE) AS ratio FROM s",
    "codec_histogram": f"WITH {_SIZED} SELECT codec, count(*) AS n, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, CAST(sum(compressed_size) AS BIGINT) AS encoded FROM s GROUP BY 1",
    "benchmark_fold": f"WITH {_SIZED}, q AS (SELECT count(*) FILTER (codec = 'pair') AS processed, count(*) FILTER (codec <> 'pair') AS skipped, CAST(sum(original_size) FILTER (codec = 'pair') AS DOUBLE) AS o, CAST(sum(compressed_size) FILTER (codec = 'pair') AS DOUBLE) AS c FROM s) SELECT processed, skipped, o / 1048576.0e0 AS original_mb, c / 1048576.0e0 AS compressed_mb, c / o AS ratio, o / 1048576.0e0 / 2.0e0 AS mb_per_s FROM q",
    "planes_lineitem": f"WITH {_PAIRED}, x AS (SELECT xor(base_part & 65535, part & 65535) AS x FROM p WHERE codec = 'pair') SELECT (x >> 7) & 255 AS exponent, ((x >> 8) & 128) | (x & 127) AS rest, count(*) AS n FROM x GROUP BY 1, 2",
    "plane_histogram": f"WITH {_PLACED} SELECT t.model_id, (xor(t.word, b.word) >> 7) & 255 AS exponent, count(*) AS n FROM n t JOIN n b ON b.model_id = 0 AND b.name = t.name AND b.place = t.place WHERE t.model_id <> 0 GROUP BY 1, 2",
    "plane_entropy": f"WITH {_WORDS}, c AS (SELECT model_id, (word >> 7) & 255 AS exponent, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT model_id, CAST(sum(n) AS BIGINT) AS total, sum(n * log2(n)) AS x FROM c GROUP BY 1) SELECT model_id, total, round(total * log2(total) - x, 6) AS bits FROM t",
    "chunk_dedup": f"WITH {_CHUNKS}, u AS (SELECT digest, count(*) AS n, max(length) AS size FROM c GROUP BY 1) {_STATS}",
    "chunk_curve": f"WITH {_CHUNKS}, {_CHUNK_GROUPS.format('total')} {_CURVE}",
    "chunk_curve_once": f"WITH {_CHUNKS}, {_CHUNK_GROUPS.format('once')} {_CURVE}",
    "tensor_curve": f"WITH {BLOBS}, f AS (SELECT hash, min(model_id) AS model_id, max(size // 3) AS stored, max(size) AS size FROM b GROUP BY 1), h AS (SELECT model_id, sum(CASE WHEN size > 100 THEN stored ELSE 0 END) AS stored FROM f GROUP BY 1), o AS (SELECT model_id, sum(size) AS original FROM b GROUP BY 1), g AS (SELECT o.model_id, original, coalesce(stored, 0) AS stored FROM o LEFT JOIN h USING (model_id)) {_CURVE}",
    "codec_curve": f"WITH {BLOBS}, g AS (SELECT model_id, sum(size) AS original, sum(size // 2) AS stored FROM b GROUP BY 1) {_CURVE}",
    "dedup_increment": f"WITH {BLOBS}, x AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY model_id, file_name, tensor_name) AS place FROM b WHERE model_id >= 'src15' AND hash NOT IN (SELECT hash FROM b WHERE model_id < 'src15')) SELECT hash, model_id, file_name, tensor_name, size FROM x WHERE place = 1",
    "restore_plan": f"WITH {_PAIRED} SELECT count(*) AS places, count(DISTINCT part) AS contents, (SELECT count(*) FROM (SELECT part FROM p UNION SELECT base_part FROM p WHERE base_part IS NOT NULL)) AS loads FROM p",
    "model_tensor_info": f"WITH {BLOBS}, d AS (SELECT hash, min(tensor_name) AS described, min(size) AS size FROM b GROUP BY 1) SELECT b.model_id, b.file_name, b.tensor_name AS name, d.described, d.size FROM b JOIN d USING (hash)",
    "verify_status": "SELECT o_custkey % 100 AS model_id, CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'FULLY' ELSE 'PARTIALLY' END AS status FROM orders GROUP BY 1",
    "model_names": r"WITH v AS (SELECT p_partkey, replace(p_brand, '#', '/') || '/' || p_name AS model_id FROM part), k AS (SELECT *, regexp_replace(model_id, '^([^/]*)/', '\1_') AS key FROM v) SELECT p_partkey, model_id, key, regexp_replace(key, '^([^_]*)_', '\1/') AS name, replace(model_id, '/', '_') AS all_keys FROM k",
    "size_texts": "SELECT p_partkey, CAST(p_size AS BIGINT) * CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 7 <= 2 THEN 1024 WHEN p_partkey % 7 <= 4 THEN 1048576 ELSE 1073741824 END AS n_bytes FROM part",
    "throughput_texts": "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'instant' WHEN o_orderkey / (o_custkey % 7) >= 1024 THEN printf('%.2f GB/s', o_orderkey / (o_custkey % 7) / 1024) ELSE printf('%.2f MB/s', o_orderkey / (o_custkey % 7)) END AS throughput FROM orders",
    "verification_fold": f"WITH {_RUNS} SELECT threads, avg(throughput) AS throughput, CASE WHEN bool_and(verification = 'PASS') THEN 'PASS' WHEN bool_or(verification = 'FAIL') THEN 'FAIL' ELSE 'UNKNOWN' END AS verification FROM r GROUP BY 1",
    "throughput_by_threads": f"WITH {_THREADS} SELECT * FROM t",
    "speedup": f"WITH {_THREADS}, s AS (SELECT threads, avg_throughput / max(avg_throughput) FILTER (threads = 1) OVER () AS speedup FROM t) SELECT threads, round(speedup, 9) AS speedup, round(speedup / threads * 100, 9) AS efficiency FROM s",
    "best_and_worst": f"WITH {_THREADS} SELECT (SELECT threads FROM t ORDER BY avg_throughput DESC, threads LIMIT 1) AS best, max(avg_throughput) AS best_value, (SELECT threads FROM t ORDER BY avg_throughput, threads LIMIT 1) AS worst, min(avg_throughput) AS worst_value FROM t",
    "download_set": "SELECT c_custkey AS model_id FROM customer WHERE c_acctbal > 1000 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders",
    "results_skip": "WITH r AS (SELECT doc_id, source AS model_id, lang AS file_name FROM documents) SELECT model_id, file_name, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM r d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE d.model_id = r.model_id AND d.file_name = r.file_name) GROUP BY 1, 2",
    "growth": "WITH g AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS new_items, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS new_size FROM orders GROUP BY 1) SELECT quarter, new_items, new_size, CAST(sum(new_items) OVER w AS DOUBLE) / 1000 AS thousands, CAST(sum(new_size) OVER w AS BIGINT) AS size FROM g WINDOW w AS (ORDER BY quarter)",
    "chunk_lines": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digest, o_custkey AS length FROM orders WHERE o_orderkey % 5 >= 2",
    "log_fields": "SELECT event_id, event_id + 0.5e0 AS compression_throughput, CAST(user_id AS DOUBLE) AS compression_time, CAST(NULL AS DOUBLE) AS compression_ratio, CASE event_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'UNKNOWN' END AS verification, true AS success FROM events",
    "lineage_lists": "SELECT r_name AS base_model_id, n_name AS model_id FROM nation JOIN region ON n_regionkey = r_regionkey",
    "file_sizes": "SELECT l_orderkey AS file, 100 + max(CAST(floor(l_extendedprice) AS BIGINT)) AS file_size FROM lineitem GROUP BY 1",
    "name_latest": "SELECT l_partkey AS name, l_orderkey AS file, l_linenumber AS line, l_suppkey AS hash FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS place FROM lineitem) WHERE place = 1",
    "content_hashes": "WITH u AS (SELECT text, count(*) AS n, CAST(max(strlen(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS uniques, CAST(sum(size) AS BIGINT) AS unique_size, CAST(sum(size * (n - 1)) AS BIGINT) AS saved FROM u",
}
