"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits, one half differs in
at most one. Each half is indexed under 32 variants, each with one bit cleared; an equality join on (half, bit, variant)
brings candidates together, and the join's condition verifies the distance and lets each link through once. The join is
always by sorting, as its rows are many more than Spark expects.

Equal fingerprints are one node, named by their smallest key, before the join; so copies make no pairs. Components come
from passing on smallest labels and jumping along them until nothing changes; each round is written to the shared
folder, so lost executors don't recompute the rounds before.

Null and empty texts have the fingerprint zero; a very long text's shingles are counted block by block. Repeated rows get equal rows; extra columns are ignored; an empty
table gives an empty result. Null keys get their fingerprint's component, or null if it is theirs alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightloom.llm.common import ship, slices, spread, work_dir

_WORDS = regex.compile(r"[^\x20\x09-\x0D]+").findall
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Shingles whose bits are counted at a time.
STEP = 1 << 16


def hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """The unsigned hashes of a text's shingles, repeats included."""
    found = _WORDS((text or "").translate(_UPPER))
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < shingle:
        parts = [" ".join(found)]
    else:
        parts = list(map(" ".join, zip(*(found[i:] for i in range(shingle)), strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts))


def majority(h: np.ndarray) -> int:
    """The signed 64-bit fingerprint of a text's hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), STEP):
        counts += np.unpackbits(h[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h)).view(">u8")[0].astype(np.int64))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    return majority(hashes(text, shingle))


def fingerprints(df: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, bits): each text's fingerprint as a signed long. No shuffle, unless the input has fewer splits than cores."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                bits = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(bits, pa.int64())], ["key", "bits"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, bits long").withColumnRenamed("key", key)


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Rows (a, b), a < b: nodes (node, bits; distinct) whose bits differ in at most `distance` places, each pair once."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves find distances up to 3")
    masks = F.sequence(F.lit(0), F.lit(31))
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    low, high = F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("bits", 32)
    parts = nodes.select("node", "bits", half).withColumn("part", F.when(F.col("half") == 0, low).otherwise(high))
    variants = parts.withColumn("place", F.explode(masks)).withColumn("variant", F.expr("part & ~shiftleft(1L, place)")).select("node", "bits", "half", "place", "variant", "part")
    x, y = variants.alias("x"), variants.alias("y")
    differs = F.col("x.part").bitwiseXOR(F.col("y.part"))

    def once(diff: Column) -> Column:
        return F.when(diff == 0, F.col("x.place") == 0).otherwise(True)

    low_diff = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")).bitwiseAND(F.lit(0xFFFFFFFF)))
    near = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= distance
    first = (F.col("x.half") == 0) | (low_diff > 1)
    same = (F.col("x.half") == F.col("y.half")) & (F.col("x.place") == F.col("y.place")) & (F.col("x.variant") == F.col("y.variant"))
    # Spark estimates the variants by the size of the fingerprints, a 64th of their rows; so it would send them all through the driver.
    return x.hint("merge").join(y.hint("merge"), same & (F.col("x.node") < F.col("y.node")) & near & once(differs) & first).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, label): each linked node's smallest reachable node. edges: (a, b)."""
    spark = edges.sparkSession
    base = work_dir(spark, name)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both.write.parquet(f"{base}/edges")
    both = spark.read.parquet(f"{base}/edges")
    both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")).write.parquet(f"{base}/0")
    step = 0
    while True:
        now = spark.read.parquet(f"{base}/{step}")
        heard = both.join(now.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        jump = now.select(F.col("node").alias("at"), F.col("label").alias("jumped"))
        new = now.join(heard, "node").withColumn("to", F.least("label", "heard")).join(jump, F.col("to") == F.col("at"))
        new = new.select("node", F.least("to", "jumped").alias("label"), (F.least("to", "jumped") < F.col("label")).alias("changed"))
        step += 1
        new.write.parquet(f"{base}/{step}")
        if spark.read.parquet(f"{base}/{step}").filter("changed").isEmpty():
            return spark.read.parquet(f"{base}/{step}").select("node", "label")


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint as 16 hex digits, component_id: the smallest key reachable over links)."""
    spark = df.sparkSession
    base = work_dir(spark, "simhash")
    fingerprints(df, shingle, key, text).write.parquet(f"{base}/bits")
    rows = spark.read.parquet(f"{base}/bits")
    rows.groupBy("bits").agg(F.min(key).alias("node")).write.parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")
    labels = components(links(nodes.filter("node is not null"), distance))
    classes = nodes.join(labels, "node", "left").select(F.col("bits").alias("_bits"), F.coalesce("label", "node").alias("component_id"))
    return rows.join(classes, F.col("bits") == F.col("_bits")).select(key, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
