"""Dimension lookups: left joins on unique ids. A dimension is left to the optimizer's size check:
small ones are broadcast, large ones joined by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, columns: dict[str, str], id: str = "id") -> DataFrame:
    """`fact` with the named columns of the row of `dim` whose id equals `key`; nulls on a miss."""
    side = dim.select(F.col(id).alias("__id"), *[F.col(c).alias(out) for c, out in columns.items()])
    return fact.join(side, fact[key] == F.col("__id"), "left").drop("__id")


def wide_sku_dim(sku: DataFrame, spu: DataFrame, trademark: DataFrame, c3: DataFrame, c2: DataFrame, c1: DataFrame) -> DataFrame:
    """The whole chain of a sku's dimensions in one row: spu, trademark, three category levels."""
    wide = sku.select("id", "sku_name", "spu_id", F.col("tm_id").alias("trademark_id"), "category3_id")
    wide = lookup_join(wide, spu, "spu_id", {"spu_name": "spu_name"})
    wide = lookup_join(wide, trademark, "trademark_id", {"tm_name": "trademark_name"})
    wide = lookup_join(wide, c3, "category3_id", {"name": "category3_name", "category2_id": "category2_id"})
    wide = lookup_join(wide, c2, "category2_id", {"name": "category2_name", "category1_id": "category1_id"})
    return lookup_join(wide, c1, "category1_id", {"name": "category1_name"})
