"""Deduplication by layer: the tensors of model.layers.N make one item, any other tensor is one of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightloom.operators import dedup


def parsed(df: DataFrame) -> DataFrame:
    """The rows with layer (its number, null outside layers) and kind (the rest of a layer tensor's name, else the name)."""
    parts = F.split("name", r"\.")
    inside = F.col("name").rlike(r"^model[.]layers[.][0-9]+([.]|$)")
    rest = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), ".")
    number = F.get(parts, F.lit(2)).try_cast("decimal(38,0)")
    return df.withColumn("layer", F.when(inside, number)).withColumn("kind", F.when(inside, rest).otherwise(F.col("name")))


def items(df: DataFrame) -> DataFrame:
    """Rows (model_id, layer, other, hash, size): one for each layer, and for each tensor outside. A layer's hash is made of its sorted parts.

    A layer's tensors are a few dozen by nature, so they are gathered in a list.
    """
    rows = parsed(df).withColumn("other", F.when(F.col("layer").isNull(), F.col("name")))
    item = F.concat_ws(":", "kind", "hash")
    return rows.groupBy("model_id", "layer", "other").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "|"), 256).alias("hash"), F.sum("size").alias("size"))


def statistics(df: DataFrame) -> DataFrame:
    """df: (model_id, name, hash, size)."""
    return dedup.statistics(items(df), "hash", "size")
