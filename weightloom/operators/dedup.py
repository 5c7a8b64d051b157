"""Deduplication by content hash.

A null hash equals no other, so its row is never a duplicate and counts as unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightloom.functions.columns import reduction as reduced


def statistics(df: DataFrame, digest: str, size: str) -> DataFrame:
    """One row: total, unique, ratio, largest and mean size of unique items, their size, and bytes saved. A missing size is 0."""
    sizes = df.select(F.col(digest).alias("digest"), F.coalesce(F.col(size), F.lit(0)).alias("size"))
    known = sizes.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    unique = known.select("n", "size").unionByName(sizes.filter("digest is null").select(F.lit(1).cast("bigint").alias("n"), "size"))
    return unique.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("uniques"),
        F.try_divide(F.count("*"), F.sum("n")).alias("unique_ratio"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("avg_size"),
        F.sum("size").alias("unique_size"),
        F.sum(F.col("size") * (F.col("n") - 1)).alias("saved"),
    )


def firsts(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Rows (digest, first): the least order of each hash, by partial aggregation, so a hot hash is no task of its own."""
    return df.filter(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest")).agg(F.min(F.struct(*order)).alias("first"))


def marked(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """The rows with is_duplicate: whether an earlier row in the order has the digest. The order must be total."""
    found = firsts(df, digest, order)
    rows = df.alias("r").join(found.alias("f"), F.col(f"r.{digest}") == F.col("f.digest"), "left")
    later = F.coalesce(F.struct(*[F.col(f"r.{c}") for c in order]) > F.col("f.first"), F.lit(False))
    return rows.select("r.*", later.alias("is_duplicate"))


def unseen(df: DataFrame, known: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """One row for each hash that `known` doesn't have: the first in the order."""
    new = df.join(known.select(digest).distinct(), digest, "left_anti")
    rest = [F.col(c) for c in df.columns if c not in order and c != digest]
    first = new.groupBy(digest).agg(F.min_by(F.struct(*[F.col(c) for c in order], *rest), F.struct(*order)).alias("x"))
    return first.select(digest, "x.*").select(*df.columns)


def processed_stay(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """The rows that `done` doesn't name."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def reduction(df: DataFrame, group: str, size: str) -> DataFrame:
    """Bytes before and after dedup in each group, from marked rows. A group without bytes has reduction 0."""
    found = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("duplicates"), F.sum(size).alias("original"), F.sum(F.when(F.col("is_duplicate"), 0).otherwise(F.col(size))).alias("stored"))
    return found.withColumn("reduction", reduced(F.col("stored"), F.col("original")))


def signature(item: Column) -> Column:
    """A hash of a group's items, whatever their order: the sum of their hashes' halves, without gathering the items.

    128 bits; two groups with different items have equal sums only by chance.
    """
    digest = F.sha2(item, 256)

    def half(at: int) -> Column:
        return F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))

    return F.concat_ws(":", F.count("*").cast("string"), *[half(at).cast("string") for at in (1, 16, 31)])
