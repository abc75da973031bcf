"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from schemaloom.runtime import materialise

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash128(value: Column) -> Column:
    """Two independent 64-bit hashes of a text, to compare texts by equality."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(value, F.lit("second")).alias("b"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_fields(schema: StructType, **fields: str) -> StructType:
    """A new schema with more fields, given as name=DDL type."""
    return StructType([*schema.fields, *(StructField(n, DataType.fromDDL(t)) for n, t in fields.items())])


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the smallest node that it is connected with.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stay the same.
    Each step sends a node's neighbours to the smallest of them, so that only minima are gathered per
    node and no neighbour list is held; every round is written to the checkpoint folder. Returns
    (node, label) for the nodes that have an edge. Self-edges, repeated edges and rows with a null are
    ignored; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = materialise(edges.distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(low.select("u", F.col("m").alias("v")).union(linked).distinct())
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select("label", "label").distinct())
