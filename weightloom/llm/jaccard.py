"""Near copies: SimHash fingerprints and MinHash bands find candidates, the exact Jaccard similarity of shingles decides.

Fingerprints that differ in at most DISTANCE bits, found by their deletion variants as in `simhash`, are candidates. A
similarity of 0.8 lies further apart, at up to 14 bits, where variants of 64 bits would join nearly all pairs. So each
text also gets BANDS keys of ROWS minimum hashes of its set, and texts that share a key are candidates too: at a
similarity of 0.8 two texts share none with a probability of (1 - 0.8^4)^25 = 2e-6. A text's set holds the XXH64 hashes
of its shingles, lower-cased; a text of fewer words is one shingle.

Pairs within a key grow with its square, and texts that hold a frequent passage share keys without being alike. So texts
of a key are compared in rounds with a leader, where the two aren't connected yet. What still shares a key with another
group goes through an exact join by prefixes: a set's hashes are ordered from the rarest to the most frequent, and two
sets that are alike share one among the first fifth of the larger and ninth of the smaller (`prefixed`). A frequent
passage stands in no such prefix, unless it makes up so much of the texts that they are alike. All pairs that share a
key are thus connected already or compared, and the groups are those of all pairs.

Equal texts are one node, named by half of their SHA-256, so rows need no key. Texts without words are all alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightloom.llm import simhash
from weightloom.llm.common import ship, slices, work_dir

BANDS, ROWS = 25, 4
#: Bits in which the fingerprints of candidates differ at most.
DISTANCE = 3
#: Rounds in which each text meets one leader of its key.
STARS = 2
#: Shingles whose permuted hashes are held at a time.
STEP = 1 << 12
#: Hashes of a prefix that are compared before a pair is made.
HELD = 256
#: Far below the least difference that a count of shingles makes, and above what rounding makes.
EPSILON = 1e-6
_RNG = np.random.default_rng(8)
_FLIP, _FACTOR = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(simhash.hashes(text, width))


def bands(found: np.ndarray) -> list[int]:
    """The signed keys of a set, one for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), STEP):
        least = np.minimum(least, ((found[at : at + STEP] ^ _FLIP) * _FACTOR).min(1))
    return [xxhash.xxh64_intdigest(x.tobytes(), n) - (1 << 63) for n, x in enumerate(least.reshape(BANDS, ROWS))]


def signature(text: str | None, width: int) -> list[int]:
    """A text's fingerprint, the size of its set and its keys."""
    h = simhash.hashes(text, width)
    found = np.unique(h)
    return [simhash.majority(h), len(found), *bands(found)]


def node_of(text: Column) -> Column:
    """The name of a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def pair(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def mapped(df: DataFrame, work, kind: str, pa_kind: pa.DataType) -> DataFrame:
    """Rows (node, out) of rows (node, text): what `work` makes of each text. No shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([work(t) for t in b.column("text").to_pylist()], pa_kind)], ["node", "out"])

    return df.select("node", "text").mapInArrow(run, f"node binary, out {kind}")


def by_variants(texts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows (a, b): texts (node, bits) whose fingerprints differ in at most `distance` bits, those of equal ones with their smallest."""
    nodes = texts.groupBy("bits").agg(F.min("node").alias("first"))
    x, y = (nodes.select(F.col("bits").alias(n), F.col("first").alias(f"first_{n}")) for n in "ab")
    linked = simhash.links(nodes.select(F.col("bits").alias("node"), "bits"), distance).join(x, "a").join(y, "b").select(*pair("first_a", "first_b"))
    return linked.union(texts.join(nodes, "bits").filter("node != first").select(*pair("node", "first")))


def by_bands(texts: DataFrame) -> DataFrame:
    """Rows (band, key, node, size), of keys that several of the texts (node, size, bands) share."""
    keys = texts.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return keys.hint("merge").join(shared.hint("merge"), ["band", "key"])


def split(labelled: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key `by` holds several labels, each with the key's most frequent one, `main`."""
    sizes = labelled.groupBy(*by, "label").agg(F.count("*").alias("rows"))
    main = sizes.groupBy(*by).agg(F.max(F.struct("rows", "label"))["label"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    return labelled.join(main, by)


def prefixed(sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b): all pairs of the sets (id, label, found) of different labels that may be alike, and few others.

    Say the smaller set has m hashes, the larger n. Alike, they share s n at least, and 2 s / (1 + s) m. The first shared
    hash in any order of all has the shared ones behind it in both; so it is among the first n - s n + 1 of the larger and
    m - 2 s / (1 + s) m + 1 of the smaller, and each has as many left from there as the two must share. The prefixes tell
    more: of what a set holds up to the lower end of the two, the other one has no more than its prefix shows.
    """
    base, spark = work_dir(sets.sparkSession, "prefixes"), sets.sparkSession
    each = sets.select("id", F.explode("found").alias("x"))
    # Hashes of one set only come first and meet none; they count, but needn't be moved.
    often = each.groupBy("x").agg(F.count("*").alias("often")).filter("often > 1")
    order = each.hint("merge").join(often.hint("merge"), "x").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("order"))
    n, alone = F.size("found"), F.col("n") - F.size("order")

    def first(share: float) -> Column:
        return F.col("n") - F.ceil(F.lit(share) * F.col("n") - F.lit(EPSILON)) + 1

    rows = order.join(sets.select("id", "label", n.alias("n")), "id").withColumn("alone", alone).withColumn("long", first(similarity))
    rows = rows.withColumn("prefix", F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("long") - F.col("alone")).cast("int"))).filter("size(prefix) > 0")
    rows.withColumn("prefix", F.col("prefix.x")).drop("order").write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    entries = rows.select("id", "label", "n", "alone", first(2 * similarity / (1 + similarity)).alias("short"), F.posexplode("prefix").alias("place", "x"))
    entries = split(entries.select("x", "id", "label", "n", (F.col("alone") + F.col("place")).alias("place"), "short"), ["x"])
    held = F.slice("prefix", 1, HELD)
    known = rows.select("id", held.alias("held"), F.least("long", F.col("alone") + F.size(held)).alias("seen"))
    entries.join(known, "id").write.parquet(f"{base}/split")
    found = spark.read.parquet(f"{base}/split")
    p, q = found.hint("merge").alias("p"), found.filter("label != main").hint("merge").alias("q")
    smaller = F.struct("p.n", "p.id") < F.struct("q.n", "q.id")
    placed = F.when(smaller, F.col("p.place") < F.col("p.short")).otherwise(F.col("q.place") < F.col("q.short"))
    sizes = F.least("p.n", "q.n") >= F.lit(similarity) * F.greatest("p.n", "q.n") - F.lit(EPSILON)
    needed = (F.lit(similarity) * (F.col("p.n") + F.col("q.n")) - F.lit(EPSILON)) / F.lit(1 + similarity)
    left = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place")) >= needed
    # What both hold of the hashes seen, and at most all that one of them has behind those; a pair counts at its first.
    common = F.array_intersect("p.held", "q.held")
    most = F.size(common) + F.greatest(F.col("p.n") - F.col("p.seen"), F.col("q.n") - F.col("q.seen")) >= needed
    once = F.coalesce(F.get(common, F.lit(0)), F.col("p.x")) == F.col("p.x")
    same = (F.col("p.x") == F.col("q.x")) & (F.col("p.label") != F.col("q.label"))
    return p.join(q, same & sizes & placed & left & most & once).select(*pair("p.id", "q.id")).distinct()


def groups(df: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text") -> DataFrame:
    """Rows (node, label), one for each text that has a near copy: the text's name, and the smallest of its group."""
    spark = df.sparkSession
    base = work_dir(spark, "jaccard")
    texts = df.select(node_of(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    longs = pa.list_(pa.int64())

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    signed = mapped(texts, lambda t: signature(t, shingle), "array<bigint>", longs).groupBy("node").agg(F.first("out").alias("out"))
    signed = stored(signed.select("node", F.get("out", F.lit(0)).alias("bits"), F.get("out", F.lit(1)).alias("size"), F.slice("out", 3, BANDS).alias("bands")), "signed")
    near, keys = stored(by_variants(signed), "near"), stored(by_bands(signed), "shared")
    wanted = keys.select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = mapped(texts.join(wanted, "node", "left_semi"), lambda t: shingles(t, shingle).view(np.int64), "array<bigint>", longs)
    sets = stored(sets.groupBy("node").agg(F.first("out").alias("found")), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (sets.select(F.col("node").alias(n), F.col("found").alias(f"found_{n}")) for n in "ab")
        rows = pairs.distinct().join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("found_a", "found_b")))
        alike = F.col("both") >= F.lit(similarity) * (F.size("found_a") + F.size("found_b") - F.col("both"))
        return stored(rows.filter(alike).select("a", "b"), name)

    def linked(rows: DataFrame) -> DataFrame:
        labels = simhash.components(rows)
        return keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    edges = spark.createDataFrame([], "a binary, b binary")
    labelled = keys.withColumn("label", F.col("node"))
    sizes = F.least("size", "lead.size") >= F.lit(similarity) * F.greatest("size", "lead.size") - F.lit(EPSILON)
    for n in range(STARS):
        leaders = labelled.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("node", F.lit(n)).alias("h"), "node", "size", "label")).alias("lead"))
        met = labelled.join(leaders, ["band", "key"]).filter("label != lead.label").filter(sizes).select(*pair("node", "lead.node"))
        edges = edges.union(verified(met if n else met.union(near), f"star{n}"))
        labelled = stored(linked(edges), f"labelled{n}")
    rest = split(labelled, ["band", "key"]).select("node", "label").distinct().withColumn("id", F.monotonically_increasing_id())
    rest = stored(rest.join(sets, "node"), "rest_sets")
    x, y = (rest.select(F.col("id").alias(n), F.col("node").alias(f"node_{n}")) for n in "ab")
    met = prefixed(rest, similarity).join(x, "a").join(y, "b").select(*pair("node_a", "node_b"))
    return simhash.components(edges.union(verified(met, "rest")))


def representatives(df: DataFrame, similarity: float = 0.8, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each group, in the table's own columns; one row of a group that has null keys only.

    Of rows that repeat that key in one group, one stays, the one with the smallest text hash.
    """
    name, at = node_of(F.col(text)), uuid.uuid4().hex
    node, label, place = f"node_{at}", f"label_{at}", f"place_{at}"
    named = df.withColumn(node, name)
    found = groups(df, similarity, shingle, text).select(F.col("node").alias(node), F.col("label").alias(label))
    # Narrow rows decide which key and text stay.
    rows = df.select(F.col(key).alias("key"), name.alias(node)).groupBy("key", node).agg(F.count("*").alias("n")).join(found, node, "left")
    rows = rows.withColumn(label, F.coalesce(label, node))
    first = rows.groupBy(label).agg(F.min_by(F.struct("key", node, "n"), F.struct(F.col("key").isNull(), "key", node)).alias("first"))
    base = work_dir(df.sparkSession, "representatives")
    first.select("first.*").write.parquet(f"{base}/stay")
    stay = df.sparkSession.read.parquet(f"{base}/stay").alias("s")
    kept = named.alias("r").join(stay, F.col(f"r.{key}").eqNullSafe(F.col("s.key")) & (F.col(f"r.{node}") == F.col(f"s.{node}")), "left_semi")
    if stay.filter("n > 1").isEmpty():
        return kept.select(*df.columns)
    # Some of these rows repeat key and text; one of each stays.
    one = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(place)).alias("row")
    return kept.withColumn(place, F.monotonically_increasing_id()).groupBy(key, node).agg(one).select("row.*")
