"""Reports: reduction curves, codec and compression statistics, throughput of repeated runs, growth.

Running sums are taken over one row for each model or quarter, so the window without partitions holds few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions.columns import ratio, reduction
from weightloom.operators import dedup

#: Bytes of metadata for an item; size of the corpus in GB and of the hub in GB that figures are projected to.
ENTRY_BYTES, CORPUS_GB, HUB_GB = 64, 74.79, 17 * 1024


def cumulative(df: DataFrame, order: str = "model_id") -> DataFrame:
    """Running bytes and reduction over rows (order, original, stored)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(order, F.sum("original").over(w).alias("original"), F.sum("stored").over(w).alias("stored"))
    return rows.withColumn("reduction", reduction(F.col("stored"), F.col("original")))


def tensor_curve(tensors: DataFrame, files: DataFrame, encodings: DataFrame) -> DataFrame:
    """After each model: encoded bytes of the tensors seen so far, once each, against the bytes of its files.

    tensors: (model_id, hash); files: (model_id, size); encodings: (hash, compressed_size). Tensors without an encoding count 0.
    """
    first = tensors.groupBy("hash").agg(F.min("model_id").alias("model_id"))
    stored = first.join(encodings.select("hash", "compressed_size"), "hash").groupBy("model_id").agg(F.sum("compressed_size").alias("stored"))
    original = files.groupBy("model_id").agg(F.sum("size").alias("original"))
    return cumulative(original.join(stored, "model_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0))))


def chunk_curve(chunks: DataFrame, repeats_in_first: bool = True) -> DataFrame:
    """After each model: bytes of chunks stored against all. chunks: (model_id, digest, length).

    With `repeats_in_first`, each place of a chunk within the first model that has it counts as stored; else only one does.
    """
    by = chunks.groupBy("model_id", "digest").agg(F.sum("length").alias("all"), F.max("length").alias("once"))
    first = by.groupBy("digest").agg(F.min("model_id").alias("first"))
    kept = F.col("all") if repeats_in_first else F.col("once")
    rows = by.join(first, "digest").groupBy("model_id").agg(F.sum("all").alias("original"), F.sum(F.when(F.col("model_id") == F.col("first"), kept).otherwise(0)).alias("stored"))
    return cumulative(rows)


def codec_curve(sizes: DataFrame) -> DataFrame:
    """After each model: compressed against original bytes. sizes: (model_id, original_size, compressed_size)."""
    return cumulative(sizes.groupBy("model_id").agg(F.sum("original_size").alias("original"), F.sum("compressed_size").alias("stored")))


def projection(stats: DataFrame) -> DataFrame:
    """Metadata of the unique items in MB, and of the hub in GB at the same rate. Statistics without items or bytes have no row."""
    mb = F.col("uniques") * ENTRY_BYTES / 1048576
    return stats.filter("uniques > 0 and avg_size > 0").select("uniques", mb.alias("metadata_mb"), (mb * HUB_GB / CORPUS_GB).alias("hub_gb"))


def compression(encodings: DataFrame) -> DataFrame:
    """One row for encodings (codec, original_size, compressed_size): tensors (a pair counts two), paired, solo, bytes and ratio."""
    pairs, solos = F.count_if(F.col("codec") == "pair"), F.count_if(F.col("codec") != "pair")
    original, compressed = F.coalesce(F.sum("original_size"), F.lit(0)), F.coalesce(F.sum("compressed_size"), F.lit(0))
    return encodings.agg((2 * pairs + solos).alias("total"), (2 * pairs).alias("paired"), solos.alias("solo"), original.alias("original"), compressed.alias("compressed"), ratio(compressed, original).alias("ratio"))


def by_codec(encodings: DataFrame) -> DataFrame:
    """Number, original and compressed bytes of each codec; bytes of those that are stored encoded, for pair and solo alone."""
    encoded = F.when(F.col("codec").isin("pair", "solo"), F.col("compressed_size")).otherwise(0)
    return encodings.groupBy("codec").agg(F.count("*").alias("n"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.sum(encoded).alias("encoded"))


def benchmark(pairs: DataFrame, seconds: Column) -> DataFrame:
    """One row for rows (codec, original_size, compressed_size): pairs processed, tensors skipped, MB, ratio and MB/s."""
    done = F.col("codec") == "pair"
    original, compressed = (F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)) for c in ("original_size", "compressed_size"))
    mb = original / F.lit(1048576.0)
    return pairs.agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("skipped"), mb.alias("original_mb"), (compressed / F.lit(1048576.0)).alias("compressed_mb"), ratio(compressed, original).alias("ratio"), F.try_divide(mb, seconds).alias("mb_per_s"))


def verification(results: DataFrame, key: str = "threads") -> DataFrame:
    """Means over repeated runs, and PASS if all passed, FAIL if any failed, else UNKNOWN."""
    status = F.when(F.bool_and(F.col("verification") == "PASS"), "PASS").when(F.bool_or(F.col("verification") == "FAIL"), "FAIL").otherwise("UNKNOWN")
    means = [F.avg(c).alias(c) for c in results.columns if c not in (key, "verification")]
    return results.groupBy(key).agg(*means, status.alias("verification"))


def throughput(records: DataFrame, key: str = "threads", value: str = "throughput") -> DataFrame:
    """Mean, least, largest and number of records for each thread count."""
    x = F.col(value)
    return records.groupBy(key).agg(F.avg(x).alias("avg_throughput"), F.min(x).alias("min_throughput"), F.max(x).alias("max_throughput"), F.count(x).alias("num_records"))


def speedup(stats: DataFrame, key: str = "threads", value: str = "avg_throughput") -> DataFrame:
    """The rows with speedup over one thread (over the fewest, if none has one) and efficiency in percent; one row per thread count."""
    w = Window.partitionBy(F.lit(1))
    least = F.min(key).over(w)
    base = F.coalesce(F.max(F.when(F.col(key) == 1, F.col(value))).over(w), F.max(F.when(F.col(key) == F.col("least"), F.col(value))).over(w))
    rows = stats.withColumn("least", least).withColumn("speedup", F.try_divide(F.col(value), base)).drop("least")
    return rows.withColumn("efficiency", F.col("speedup") / F.col(key) * 100)


def extremes(stats: DataFrame, key: str = "threads", value: str = "avg_throughput") -> DataFrame:
    """One row: the thread counts of the best and the worst value; of equal values the smaller count."""
    best, worst = F.max(F.struct(F.col(value), -F.col(key))), F.min(F.struct(F.col(value), F.col(key)))
    return stats.agg((-best["col2"]).alias("best"), best[value].alias("best_value"), worst[key].alias("worst"), worst[value].alias("worst_value"))


def exactness(rows: DataFrame, restored: str, original: str) -> DataFrame:
    """One row: tensors whose bytes agree, those whose don't, all."""
    same = F.coalesce(F.col(restored) == F.col(original), F.lit(False))
    return rows.agg(F.count_if(same).alias("exact"), F.count_if(~same).alias("different"), F.count("*").alias("total"))


def growth(sizes: DataFrame, quarter: str = "quarter") -> DataFrame:
    """For each quarter: items in thousands and bytes, new and up to then. sizes: (quarter, size)."""
    rows = sizes.groupBy(quarter).agg(F.count("*").alias("new_items"), F.sum("size").alias("new_size"))
    w = Window.orderBy(quarter).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(quarter, "new_items", "new_size", (F.sum("new_items").over(w) / 1000).alias("thousands"), F.sum("new_size").over(w).alias("size"))


def merged(stats: list[DataFrame]) -> DataFrame:
    """Counters of several runs, summed column by column."""
    rows = stats[0]
    for more in stats[1:]:
        rows = rows.unionByName(more)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def status(files: DataFrame) -> DataFrame:
    """FULLY or PARTIALLY for each model of (model_id, is_processed)."""
    return files.groupBy("model_id").agg(F.when(F.bool_and(F.coalesce("is_processed", F.lit(False))), "FULLY").otherwise("PARTIALLY").alias("status"))


def file_items(tensors: DataFrame, keys: list[str]) -> DataFrame:
    """Files as items (keys, hash, size): a file's hash is made from its tensors', whatever their order and number."""
    return tensors.groupBy(*keys).agg(dedup.signature(F.col("hash")).alias("hash"), F.sum("size").alias("size"))
