"""Tensor files, codecs, ingest and restore on small files made here."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weightloom.functions import chunking, codecs
from weightloom.operators import reports, repository
from weightloom.sinks import files as sinks
from weightloom.sources import safetensors
from weightloom.streaming import incremental


def tensor_file(path, tensors, metadata=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    head = safetensors.header_of([(n, d, s, len(b)) for n, d, s, b in tensors], metadata)
    path.write_bytes(head + b"".join(b for *_, b in tensors))
    return path


def tuned(raw, seed):
    words = np.frombuffer(raw, "<u2").copy()
    words[:: 5 + seed] ^= 3
    return words.tobytes()


@pytest.fixture
def models(tmp_path):
    rng = random.Random(3)
    a, b, odd = rng.randbytes(6000), rng.randbytes(64), rng.randbytes(33)
    root = tmp_path / "models"
    tensor_file(root / "org_base" / "one.safetensors", [("a", "BF16", [3000], a), ("b", "BF16", [32], b), ("odd", "U8", [33], odd), ("none", "F32", [0], b"")], {"format": "pt"})
    tensor_file(root / "org_base" / "two.safetensors", [("a2", "BF16", [3000], a), ("scalar", "F32", [], b"1234")])
    tensor_file(root / "x_tuned" / "one.safetensors", [("a", "BF16", [3000], tuned(a, 0)), ("b", "BF16", [4, 8], tuned(b, 1)), ("odd", "U8", [33], bytes(33)), ("same", "BF16", [32], b)])
    (root / "x_tuned" / "two.safetensors").write_bytes((root / "org_base" / "two.safetensors").read_bytes())
    tensor_file(root / "x_other" / "one.safetensors", [("a", "BF16", [3000], tuned(a, 2)), ("c", "I8", [1], b"z")])
    return root


def lineage(spark):
    return spark.createDataFrame([("org_base", "x_tuned"), ("org_base", "x_other")], "base_model_id string, model_id string")


def same_files(root, out):
    found = sorted(p.relative_to(root) for p in root.rglob("*.safetensors"))
    return found and all((out / p).read_bytes() == (root / p).read_bytes() for p in found)


@pytest.mark.parametrize("chunk", [1 << 10, 16 << 20])
def test_restored_files_equal_what_was_ingested(spark, models, tmp_path, chunk):
    files, root = safetensors.files(spark, str(models), recursive=True), str(tmp_path / "store")
    assert repository.ingest(spark, root, files, lineage(spark), chunk)
    assert repository.ingest(spark, root, files, lineage(spark), chunk) is None
    got = repository.restore(spark, root, str(tmp_path / "out")).collect()
    assert len(got) == 5 and all(r.exact for r in got) and same_files(models, tmp_path / "out")
    codec = {r.name: r.codec for r in repository.table(spark, root, "tensors").join(repository.encodings(spark, root), "hash").collect() if r.name in ("a", "b", "odd", "none")}
    by_codec = {r.codec: r.n for r in reports.by_codec(repository.encodings(spark, root)).collect()}
    assert by_codec == {"pair": 2, "solo": 8} and codec["none"] == "solo"
    plan = repository.restore_plan(repository.model_tensors(spark, root), repository.encodings(spark, root), "x_tuned").first()
    assert plan.asDict() == {"tensors": 6, "unique_loads": 6, "pairs": 1, "solos": 5, "missing": 0}
    assert {r.status for r in repository.verified(spark, root).collect()} == {"FULLY"}
    assert repository.exists(spark, root, "models", model_id="x_tuned") and not repository.exists(spark, root, "models", model_id="y")
    with pytest.raises(ValueError, match="unknown models: y"):
        repository.restore(spark, root, str(tmp_path / "out"), ["y"])


def test_a_later_ingest_pairs_with_stored_bases_and_adds_only_what_is_new(spark, models, tmp_path):
    files, root = safetensors.files(spark, str(models), recursive=True), str(tmp_path / "store")
    repository.ingest(spark, root, files.filter("model_id = 'org_base'"), lineage(spark), 1 << 10)
    before = repository.table(spark, root, "tensors").count()
    repository.ingest(spark, root, files, lineage(spark), 1 << 12)
    assert (before, repository.table(spark, root, "tensors").count()) == (5, 10)
    assert {r.codec: r.n for r in reports.by_codec(repository.encodings(spark, root)).collect()}["pair"] == 2
    repository.restore(spark, root, str(tmp_path / "out")).collect()
    assert same_files(models, tmp_path / "out")


def test_an_ingest_that_fails_leaves_nothing_that_counts(spark, models, tmp_path):
    (models / "x_other" / "bad.safetensors").write_bytes(struct.pack("<Q", 90) + b"{}")
    files, root = safetensors.files(spark, str(models), recursive=True), str(tmp_path / "store")
    with pytest.raises(ValueError, match="bad.safetensors: header cut short"):
        repository.ingest(spark, root, files, lineage(spark))
    assert repository.table(spark, root, "model_files").isEmpty()


def test_stream_goes_on_where_it_ended(spark, models, tmp_path):
    root, point = str(tmp_path / "store"), str(tmp_path / "point")
    incremental.ingest_stream(spark, str(models), root, lineage(spark), point, files_per_batch=2).awaitTermination()
    tensor_file(models / "x_other" / "more.safetensors", [("d", "I8", [2], b"zy")])
    incremental.ingest_stream(spark, str(models), root, lineage(spark), point).awaitTermination()
    n = repository.table(spark, root, "commits").count()
    incremental.ingest_stream(spark, str(models), root, lineage(spark), point).awaitTermination()
    assert repository.table(spark, root, "commits").count() == n
    repository.restore(spark, root, str(tmp_path / "out")).collect()
    assert same_files(models, tmp_path / "out")


def entry(begin, end, dtype='"F32"', shape="[1]"):
    return f'{{"dtype":{dtype},"shape":{shape},"data_offsets":[{begin},{end}]}}'


MALFORMED = {
    "short": b"1234567",
    "cut": struct.pack("<Q", 50) + b"{}",
    "huge": b"\xff" * 8 + b"{}",
    "text": struct.pack("<Q", 5) + b"hello",
    "list": struct.pack("<Q", 2) + b"[]",
    "offsets": None,
    "beyond": None,
    "turned": None,
}


def test_malformed_files_have_an_error_either_way(spark, tmp_path):
    for name, raw in MALFORMED.items():
        if raw is None:
            text = {"offsets": '{"a":{"dtype":"F32","shape":[1]}}', "beyond": f'{{"a":{entry(0, 9)}}}', "turned": f'{{"a":{entry(4, 2)}}}'}[name].encode()
            raw = struct.pack("<Q", len(text)) + text + b"12345678"
        (tmp_path / f"{name}.safetensors").write_bytes(raw)
    tensor_file(tmp_path / "fine.safetensors", [("a", "F32", [1], b"1234"), ("s", "F32", [], b"5678")], {"k": "v"})
    files = safetensors.files(spark, str(tmp_path), content=True)

    def rows(df):
        return sorted(((r.file_name, r.name, str(r.shape), r.begin, r.end, r.error) for r in df.collect()), key=str)

    whole, ranged = rows(safetensors.entries(files)), rows(safetensors.headers_by_range(files))
    assert whole == ranged
    assert {x[0].split(".")[0] for x in whole if x[5]} == set(MALFORMED) and sum(x[5] is None for x in whole) == 2
    data = {r.name: bytes(r.data) for r in safetensors.tensors(files).collect()}
    assert data == {"a": b"1234", "s": b"5678"}
    assert [bytes(r.data) for r in safetensors.tensor_bytes(files, files.filter("file_name = 'fine.safetensors'").first().path, "s").collect()] == [b"5678"]
    head = files.select("file_name", safetensors.header_bytes(F.col("content")).alias("h"), safetensors.header_json(F.col("content")).alias("j"), "content").filter("file_name = 'fine.safetensors'").first()
    assert bytes(head.content).startswith(bytes(head.h)) and '"__metadata__"' in head.j
    sizes = safetensors.file_size(safetensors.entries(files).filter("error is null"), "file_name").first()
    assert sizes.file_size == len(head.content)


def test_range_chunks_are_the_tensors_bytes(spark, tmp_path):
    raw = random.Random(1).randbytes(1001)
    tensor_file(tmp_path / "f.safetensors", [("x", "U8", [1001], raw), ("y", "U8", [0], b"")])
    rows = safetensors.chunks(safetensors.headers_by_range(safetensors.files(spark, str(tmp_path))), 100).collect()
    assert b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.chunk_no) if r.name == "x") == raw
    assert [bytes(r.data) for r in rows if r.name == "y"] == [b""]


@pytest.mark.parametrize("n", [2, 64, 5000])
def test_codecs_are_exact(n):
    rng = random.Random(n)
    base, data = rng.randbytes(n), rng.randbytes(n)
    assert codecs.decode_pair(base, codecs.encode_pair(base, data)) == data
    assert codecs.decode_pair_chunked(base, *codecs.encode_pair_chunked(base, data, 1000)) == data
    for raw in (data, data + b"x", b"", b"q"):
        for codec in ("solo", "raw", "split"):
            assert codecs.CODECS[codec].decode(None, codecs.CODECS[codec].encode(None, raw)) == raw


def test_planes_and_errors():
    exponents, rest = codecs.planes(b"\x00\x00\x01", b"\xff\xff\x01\x05")
    assert (exponents, rest) == (b"\xff", b"\xff")
    assert codecs.planes(struct.pack("<H", 0), struct.pack("<H", 0x8001 | 5 << 7)) == (b"\x05", b"\x81")
    for bad in (lambda: codecs.planes(b"1", b"22"), lambda: codecs.unframed(b"123"), lambda: codecs.unframed(struct.pack("<Q", 9) + b"1"), lambda: codecs.joined(b"12", b"1", b""), lambda: codecs.joined(b"", b"1", b"1")):
        with pytest.raises(ValueError):
            bad()
    assert codecs.decompress(codecs.compress(b"a") + codecs.compress(b"b")) == b"ab"
    assert codecs.content_hash(b"") == "2d06800538d394c2" and codecs.content_hash(b"abc") == "78af5f94892f3950"
    with pytest.raises(ValueError):
        codecs.register("pair", codecs.CODECS["solo"])


def scalar_cuts(data, mean):
    """Chunk ends by the definition, byte by byte."""
    gear, (strict, loose), out, at = [int(x) for x in chunking.gear()], chunking.masks(mean), [], 0
    while at < len(data):
        end = min(len(data), at + 4 * mean)
        for i in range(at, end):
            h = sum(gear[data[j]] << (i - j) for j in range(max(0, i - 63), i + 1)) & (1 << 64) - 1
            size = i + 1 - at
            if size > mean // 4 and h & (strict if size <= mean else loose) == 0:
                end = i + 1
                break
        out.append(end)
        at = end
    return out


@pytest.mark.parametrize("n", [0, 1, 15, 16, 700, 6000])
def test_chunks_equal_the_definition(n):
    raw = random.Random(n).randbytes(n)
    assert chunking.cuts(raw, 64) == scalar_cuts(raw, 64)


def test_chunks_find_shifted_copies(spark):
    rng = random.Random(4)
    body = rng.randbytes(60_000)
    df = spark.createDataFrame([("m1", body), ("m2", rng.randbytes(100) + body), ("m3", None), ("m4", b"")], "model_id string, data binary")
    rows = chunking.chunks(df, mean=1024).collect()
    by = {m: [r for r in rows if r.model_id == m] for m in ("m1", "m2", "m3", "m4")}
    assert sum(r.length for r in by["m1"]) == 60_000 and not by["m3"] and not by["m4"]
    shared = {r.digest for r in by["m1"]} & {r.digest for r in by["m2"]}
    assert len(shared) >= len(by["m1"]) - 4


def test_save_and_combine(spark, tmp_path):
    rows = [("1.safetensors", "b", "U8", [2], b"bb"), ("1.safetensors", "a", "U8", [], b"a"), ("2.safetensors", "b", "U8", [3], b"ccc")]
    df = spark.createDataFrame(rows, "file_name string, name string, dtype string, shape array<bigint>, data binary")
    sinks.save_tensors(df, str(tmp_path / "m")).collect()
    sinks.save_tensors(sinks.combined(df), str(tmp_path / "c")).collect()
    got = {(r.file_name, r.name): bytes(r.data) for folder in ("m", "c") for r in safetensors.tensors(safetensors.files(spark, str(tmp_path / folder), content=True)).collect()}
    assert got == {("1.safetensors", "a"): b"a", ("1.safetensors", "b"): b"bb", ("2.safetensors", "b"): b"ccc", ("combined.safetensors", "a"): b"a", ("combined.safetensors", "b"): b"ccc"}


def test_plane_files(tmp_path):
    (tmp_path / "b").write_bytes(b"12345")
    (tmp_path / "t").write_bytes(b"1254")
    assert sinks.write_planes(str(tmp_path / "b"), str(tmp_path / "t"), str(tmp_path / "out"))["exp.bin"] == 2
    assert codecs.joined(b"1234", *((tmp_path / "out" / f).read_bytes() for f in ("exp.bin", "sm.bin"))) == b"1254"
