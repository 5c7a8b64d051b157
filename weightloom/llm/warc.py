"""WARC: a deterministic writer of sharded archives, and their reader.

Records are range-sorted by key, so each task writes one run of keys. A file is closed once its compressed size passes
the limit; every record is a gzip member of its own. Headers and digests are made anew from the payload. Files are
written under temporary names of the attempt, moved to names made from their first key and content, and named by a
manifest row; what no manifest row names doesn't count, so a lost attempt can't be read.

Of records with equal payloads of at least `least` bytes, that with the largest key is the response and others revisit
it; smaller payloads are always responses. Payloads are compared by digest and length, on narrow rows, with partial
maxima first; the payloads move once, in the sort by (key, digest), where the revisit note of a key and digest meets its
rows; so a key that many rows repeat is split over tasks too.

Null payloads are empty, null URLs have no target. Rows that repeat the largest key of a payload are all responses, of
other rows that repeat a key each has a record. Null keys sort first and count as the smallest: such a record has an
identifier made from its digest and URL and no key; it revisits a keyed record of its payload, without one it is a response.
A very long payload is one record, held whole. Extra columns are ignored; an empty table writes no files. Which records
share a file depends on the rows and on the number of shuffle partitions, nothing else.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.llm.common import open_fs, ship, shuffle_partitions, slices, work_dir

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID(int=0)
_MANIFEST = "name string, first long, n_records long, n_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int | None, other: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'null {other}' if key is None else str(key))}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. Its content depends on the arguments alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, f'{digest} {url}')}", f"WARC-Date: {DATE}"]
    target = "".join((url or "").split())
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if key is not None:
        lines.append(f"X-Record-Key: {key}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    else:
        lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must start with its version")
        headers = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def write(df: DataFrame, out: str | None = None, limit: int = 64 << 20, least: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write all rows; returns the folder, with its manifest in `manifest`."""
    spark = df.sparkSession
    ship(spark)
    out = out or work_dir(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = rows.filter(F.octet_length("payload") >= least).select("key", "digest", F.octet_length("payload").alias("n"))
    narrow.write.mode("overwrite").parquet(f"{out}/digests")
    narrow = spark.read.parquet(f"{out}/digests")
    last = narrow.groupBy("digest", "n").agg(F.max("key").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    notes = narrow.join(last, ["digest", "n"]).filter("key < refers_to or (key is null and refers_to is not null)").select("key", "digest", "refers_to")
    notes.distinct().write.mode("overwrite").parquet(f"{out}/revisits")
    notes = spark.read.parquet(f"{out}/revisits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(out)
        noted = note = None
        sink = temporary = digest = None
        first = count = size = 0

        def close() -> pa.RecordBatch:
            sink.close()
            name = f"{'null' if first is None else f'{first:020d}'}-{digest.hexdigest()[:16]}.warc.gz"
            fs.move(temporary, f"{at}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["name", "first", "n_records", "n_bytes"])

        for whole in batches:
            for b in slices(whole, "payload"):
                for k, u, p, d, r in zip(*(b.column(n).to_pylist() for n in ("key", "url", "payload", "digest", "refers_to")), strict=True):
                    if r is not None:
                        noted, note = (k, d), r
                        continue
                    member = record(k, u, p, note if noted == (k, d) else None)
                    if sink is not None and size + len(member) > limit:
                        yield close()
                        sink = None
                    if sink is None:
                        fs.create_dir(f"{at}/tmp", recursive=True)
                        temporary = f"{at}/tmp/{uuid.uuid4().hex}"
                        sink, digest, first, count, size = fs.open_output_stream(temporary, compression=None), hashlib.sha256(), k, 0, 0
                    sink.write(member)
                    digest.update(member)
                    count, size = count + 1, size + len(member)
        if sink is not None:
            yield close()

    empty = F.lit(None)
    both = notes.select("key", empty.cast("string").alias("url"), empty.cast("binary").alias("payload"), "digest", "refers_to")
    both = both.unionByName(rows.select("key", "url", "payload", "digest", empty.cast("long").alias("refers_to")))
    both = both.repartitionByRange(shuffle_partitions(spark), "key", "digest").sortWithinPartitions("key", "digest", F.col("refers_to").asc_nulls_last(), "url", "payload")
    both.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    return out


def read(spark: SparkSession, out: str, key: str = "page_id") -> DataFrame:
    """Rows (key, payload_bytes, payload_digest, record_type, refers_to), from the archives the manifest names.

    A response's digest is made from the payload read and checked against its header.
    """
    ship(spark)
    names = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest").select("name")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(out)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        fields = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.open(raw) as f:
                    for headers, block in parse(io.BufferedReader(f)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                        if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                            raise ValueError(f"record {headers['WARC-Record-ID']} doesn't match its digest")
                        refers, own = headers.get("X-Refers-To-Key"), headers.get("X-Record-Key")
                        rows.append((None if own is None else int(own), size, digest.hex(), headers["WARC-Type"], None if refers is None else int(refers)))
                        if len(rows) >= 10_000:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    found = names.repartition(shuffle_partitions(spark)).mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)
