"""Text and JSON sources: model lists, lineage maps, chunk lists, results, logs, configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.functions.columns import model_key

#: Fields of a throughput log, and the pattern that finds each.
LOG_FIELDS = {
    "compression_throughput": r"(?:Compression throughput|Throughput): ([\d.]+) MB/s",
    "compression_time": r"Compression time: ([\d.]+) seconds",
    "compression_ratio": r"Compression ratio: ([\d.]+)",
    "decompression_throughput": r"Decompression throughput: ([\d.]+) MB/s",
    "decompression_time": r"Decompression time: ([\d.]+) seconds",
}
RESTORE_RECORD = r"Decompression:\s+[\d.]+s\s+\((\d+\.?\d*)\s+GB/s\s+FT\s+throughput\)"


def model_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines as model names: trimmed, without blank lines and those that start with `#`; `key` is the folder's name."""
    name = F.trim(F.col(value))
    rows = lines.withColumn("model_id", name).filter("model_id != '' and not startswith(model_id, '#')")
    return rows.withColumn("key", model_key(F.col("model_id")))


def read_model_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no, model_id, key) of a file, in its order; one file is one task, so ids grow with the lines."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return model_list(whole).select(F.col("line_no").cast("long").alias("line_no"), "model_id", "key")


def lineage_of_list(models: DataFrame) -> DataFrame:
    """Rows (base_model_id, model_id): the first line is the base of the others. Fewer than two models are an error."""
    ordered = models.agg(F.sort_array(F.collect_list(F.struct("line_no", "model_id"))).alias("all"))
    names = F.transform("all", lambda x: x["model_id"])
    enough = F.when(F.size("all") >= 2, names).otherwise(F.raise_error(F.lit("a list needs a base and a finetuned model")).cast("array<string>"))
    return ordered.select(enough.alias("names")).select(F.col("names")[0].alias("base_model_id"), F.explode(F.slice("names", F.lit(2), F.size("names"))).alias("model_id"))


def lineage_json(edges: DataFrame) -> DataFrame:
    """One row: the JSON map from each base to its models, both sorted. Lineage has a row for each model, so it fits."""
    lists = edges.groupBy("base_model_id").agg(F.sort_array(F.collect_set("model_id")).alias("models"))
    return lists.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("base_model_id", "models"))))).alias("value"))


def read_lineage(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows (base_model_id, model_id) of JSON maps. Names stay as they are, underscores included."""
    parsed = lines.select(F.explode(F.from_json(F.col(value), "map<string,array<string>>")).alias("base_model_id", "models"))
    return parsed.select("base_model_id", F.explode("models").alias("model_id")).distinct()


def chunk_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """The other columns, with (digest, length) of lines that have two fields; others are dropped."""
    fields = F.split(F.trim(F.col(value)), r"\s+")
    rows = lines.filter(F.size(fields) == 2).withColumns({"digest": F.get(fields, F.lit(0)), "length": F.get(fields, F.lit(1)).try_cast("bigint")})
    return rows.filter("length is not null").drop(value)


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """The line of each chunk in a chunk list."""
    return chunks.select(F.concat_ws(" ", "digest", F.col("length").cast("string")).alias("value"))


def chunk_list_name(path: Column) -> Column:
    """The default name of a file's chunk list: its extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".chunks.txt"))


def results(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows (model_id, file_name, original_size, compressed_size) of JSON results; text that isn't JSON has none."""
    kind = "map<string,map<string,struct<original_size:bigint,compressed_size:bigint>>>"
    by_model = lines.select(F.explode(F.from_json(F.col(value), kind)).alias("model_id", "files"))
    return by_model.select("model_id", F.explode("files").alias("file_name", "x")).select("model_id", "file_name", "x.*")


def results_json(sizes: DataFrame) -> DataFrame:
    """One JSON line for each model, as `results` reads them."""
    one = sizes.groupBy("model_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_name", F.struct("original_size", "compressed_size"))))).alias("files"))
    return one.select(F.to_json(F.create_map("model_id", "files")).alias("value"))


def log_fields(logs: DataFrame, value: str = "value") -> DataFrame:
    """The other columns, the fields of a throughput log (null if missing), verification and success."""
    text = F.col(value)
    found = {name: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double") for name, pattern in LOG_FIELDS.items()}
    failed = text.contains("WARNING") & text.contains("failed bit-exact verification")
    found["verification"] = F.when(text.contains("All tensors passed bit-exact verification"), "PASS").when(failed, "FAIL").otherwise("UNKNOWN")
    return logs.withColumns(found).withColumn("success", F.col("compression_throughput").isNotNull()).drop(value)


def restore_records(logs: DataFrame, value: str = "value") -> DataFrame:
    """The other columns, with a row for each restore record: its throughput in GB/s."""
    all_found = F.regexp_extract_all(F.col(value), F.lit(RESTORE_RECORD), F.lit(1))
    return logs.withColumn("throughput", F.explode(F.transform(all_found, lambda x: x.cast("double")))).drop(value)


@dataclass(frozen=True)
class Config:
    """Where things lie, and the model list and lineage to work on."""

    model_dir: str = "models"
    storage_dir: str = "storage"
    models_to_process: str = "models.txt"
    base_ft_path: str = "base_ft.json"
    threads: int = 0

    @classmethod
    def load(cls, path: str) -> Config:
        """Each missing field takes its default; relative paths count from the file's folder. A missing file is an error."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if not isinstance(given, dict):
            raise ValueError("a configuration is a JSON object")
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v is not None}
        found, folder = cls(**known), os.path.dirname(os.path.abspath(path))
        paths = ("model_dir", "storage_dir", "models_to_process", "base_ft_path")
        return replace(found, **{k: v if "://" in (v := getattr(found, k)) else os.path.normpath(os.path.join(folder, v)) for k in paths})


@dataclass(frozen=True)
class Experiment:
    """Settings of the chunk and codec comparison; a value that is missing, empty or zero takes its default."""

    output_root: str = "results"
    model_root: str = "models"
    fastcdc_avg_size: int = 65536

    @classmethod
    def load(cls, path: str) -> Experiment:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        return cls(**{k: given[k] for k in cls.__dataclass_fields__ if given.get(k)})
