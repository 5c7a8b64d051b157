"""Text sources, configuration, reports and layers on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from weightloom.functions import columns
from weightloom.operators import dedup, layers, pairing, reports
from weightloom.sinks import files as sinks
from weightloom.sources import lists


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_model_lists_and_lineage(spark, tmp_path):
    path = tmp_path / "models.txt"
    path.write_text("  org/base \n\n# a comment\norg/one/x\r\nplain\n")
    models = lists.read_model_list(spark, str(path))
    assert values(models, "model_id", "key") == [("org/base", "org_base"), ("org/one/x", "org_one/x"), ("plain", "plain")]
    edges = lists.lineage_of_list(models)
    assert values(edges, "base_model_id", "model_id") == [("org/base", "org/one/x"), ("org/base", "plain")]
    text = lists.lineage_json(edges)
    assert json.loads(text.first().value) == {"org/base": ["org/one/x", "plain"]}
    assert values(lists.read_lineage(text), "model_id") == [("org/one/x",), ("plain",)]
    with pytest.raises(Exception, match="a list needs a base"):
        lists.lineage_of_list(models.limit(1)).collect()


def test_results_and_chunk_lists(spark):
    sizes = spark.createDataFrame([("m", "f", 10, 4), ("m", "g", 0, 0), ("n", "f", 7, 7)], "model_id string, file_name string, original_size long, compressed_size long")
    assert values(lists.results(lists.results_json(sizes)), *sizes.columns) == values(sizes, *sizes.columns)
    assert lists.results(spark.createDataFrame([("no json",), ("",)], "value string")).count() == 0
    chunks = spark.createDataFrame([("ab", 5), ("cd", 6)], "digest string, length long")
    lines = lists.chunk_lines(chunks).union(spark.createDataFrame([("one",), ("a b c",), ("x y",), ("",)], "value string"))
    assert values(lists.chunk_list(lines), "digest", "length") == [("ab", 5), ("cd", 6)]
    names = spark.createDataFrame([("a/b.c/model.safetensors",), ("x",)], "p string").select(lists.chunk_list_name(F.col("p")).alias("n"))
    assert values(names, "n") == [("a/b.c/model.chunks.txt",), ("x.chunks.txt",)]


def test_logs(spark):
    text = "Throughput: 12.5 MB/s\nCompression ratio: 0.4\nAll tensors passed bit-exact verification"
    r = lists.log_fields(spark.createDataFrame([(1, text)], "threads long, value string")).first()
    assert (r.compression_throughput, r.compression_ratio, r.compression_time, r.verification, r.success) == (12.5, 0.4, None, "PASS", True)
    r = lists.log_fields(spark.createDataFrame([(1, "")], "threads long, value string")).first()
    assert (r.verification, r.success) == ("UNKNOWN", False)
    log = "Decompression:  1.50s (2.25 GB/s FT throughput)\nx\nDecompression: 1s (3 GB/s FT throughput)"
    assert values(lists.restore_records(spark.createDataFrame([(4, log), (8, "")], "threads long, value string")), "threads", "throughput") == [(4, 2.25), (4, 3.0)]


def test_configuration(tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"model_dir": "m", "storage_dir": "/abs", "other": 1}')
    found = lists.Config.load(str(path))
    assert found.model_dir == str(tmp_path / "m") and found.storage_dir == "/abs" and found.threads == 0
    with pytest.raises(FileNotFoundError):
        lists.Config.load(str(tmp_path / "missing.json"))
    path.write_text('{"output_root": "", "fastcdc_avg_size": 0, "model_root": "r"}')
    assert lists.Experiment.load(str(path)) == lists.Experiment("results", "r", 65536)


def test_dedup_with_nulls_zeros_and_ties(spark):
    rows = [("a", 1, "x", 0), ("a", 2, "x", 0), ("b", 1, None, 5), ("b", 2, None, 5), ("c", 1, "y", None)]
    df = spark.createDataFrame(rows, "model_id string, n long, hash string, size long")
    marked = dedup.marked(df, "hash", ["model_id", "n"])
    assert values(marked, "model_id", "n", "is_duplicate") == [("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("c", 1, False)]
    assert values(dedup.reduction(marked, "model_id", "size"), "model_id", "reduction") == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
    s = dedup.statistics(df, "hash", "size").first()
    assert (s.total, s.uniques, s.unique_size, s.saved) == (5, 4, 10, 0)
    empty = dedup.statistics(df.limit(0), "hash", "size").first()
    assert (empty.total, empty.uniques, empty.unique_ratio) == (0, 0, None)
    assert reports.projection(dedup.statistics(df.limit(0), "hash", "size")).count() == 0
    assert reports.compression(spark.createDataFrame([], "codec string, original_size long, compressed_size long")).first().ratio == 1.0


def test_layers_by_number_and_long_names(spark):
    tail = ".".join(f"p{i}" for i in range(1200))
    rows = [("m", "model.layers.0.q", "h1"), ("m", "0", "h2"), ("m", "model.layers.00.k", "h3"), ("n", f"model.layers.1.{tail}", "h4"), ("n", f"model.layers.2.{tail}x", "h4"), ("n", "model.layers.x.q", "h1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "model_id string, name string, hash string, size long")
    s = layers.statistics(df).first()
    assert (s.total, s.uniques) == (5, 5)
    same = df.filter("hash = 'h4'").withColumn("name", F.regexp_replace("name", "x$", ""))
    assert layers.statistics(same).first().uniques == 1


def test_a_name_that_the_base_has_twice_counts_with_its_last_row(spark):
    base = spark.createDataFrame([("w", "F32", 1), ("w", "BF16", 2)], "name string, dtype string, place long")
    tuned = spark.createDataFrame([("w", "BF16"), ("v", "BF16"), (None, "BF16")], "name string, dtype string")
    assert values(pairing.pair(tuned, base, ["dtype"], order=["place"], carry=["place"]), "name", "codec", "base_place") == [("v", "solo", None), ("w", "pair", 2), (None, "solo", None)]


def test_columns(spark):
    df = spark.createDataFrame([([2, 3], "BF16"), ([], "F32"), ([4], "?")], "shape array<bigint>, dtype string")
    assert values(df.select(columns.declared_bytes(F.col("shape"), F.col("dtype")).alias("n")), "n") == [(12,), (4,), (None,)]
    with pytest.raises(Exception, match="invalid size"):
        spark.createDataFrame([("5 parsecs",)], "s string").select(columns.size_in_bytes(F.col("s"))).collect()


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0), (4, 3.0)], "threads long, avg_throughput double")
    assert values(reports.speedup(rows), "threads", "speedup", "efficiency") == [(1, 1.0, 100.0), (2, 1.5, 75.0), (4, 1.5, 37.5)]
    assert reports.extremes(rows).first().asDict() == {"best": 2, "best_value": 3.0, "worst": 1, "worst_value": 2.0}
    assert reports.merged([rows, rows]).first().avg_throughput == 16.0
    sinks.write_report(spark, rows, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("*.csv"))
    assert text.splitlines()[:2] == ["threads,avg_throughput", "1,2.000"]
