"""Pairing of finetuned tensors with their base, and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, name: list[str], order: list[str]) -> DataFrame:
    """One row for each name: the last in the order."""
    rest = [c for c in df.columns if c not in name]
    found = df.groupBy(*name).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return found.select(*name, "x.*").select(*df.columns)


def fits(base: dict[str, Column], tuned: dict[str, Column]) -> Column:
    """Whether all columns agree; a null doesn't."""
    ok = F.lit(True)
    for c in base:
        ok = ok & F.coalesce(base[c] == tuned[c], F.lit(False))
    return ok


def pair(tuned: DataFrame, base: DataFrame, equal: list[str], name: str = "name", order: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """The finetune's rows with codec: pair if the base has the name and the columns named are equal, else solo.

    A name that the base has twice counts with its last row by `order` (by default by all other columns). Columns to
    `carry` from the base come as base_<column>, null for a solo.
    """
    others = [c for c in base.columns if c != name]
    known = latest(base, [name], order or others) if others else base.distinct()
    rows = tuned.alias("t").join(known.withColumn("known", F.lit(True)).alias("b"), F.col(f"t.{name}") == F.col(f"b.{name}"), "left")
    ok = F.coalesce(F.col("b.known"), F.lit(False)) & fits({c: F.col(f"b.{c}") for c in equal}, {c: F.col(f"t.{c}") for c in equal})
    carried = [F.when(ok, F.col(f"b.{c}")).alias(f"base_{c}") for c in carry or ()]
    return rows.select("t.*", F.when(ok, "pair").otherwise("solo").alias("codec"), *carried)


def base_of(models: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (model_id, base_model_id): null for a base and for a model without one; of several bases the smallest."""
    bases = edges.select(F.col("base_model_id").alias("model_id")).distinct()
    found = edges.groupBy("model_id").agg(F.min("base_model_id").alias("base_model_id")).join(bases, "model_id", "left_anti")
    return models.join(found, "model_id", "left").select("model_id", "base_model_id")


def wanted(lists: list[DataFrame], have: DataFrame, column: str = "model_id") -> DataFrame:
    """The distinct names of all lists that aren't there yet."""
    names = lists[0].select(column)
    for more in lists[1:]:
        names = names.union(more.select(column))
    return names.distinct().join(have.select(column).distinct(), column, "left_anti")
