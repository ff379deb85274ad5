"""A knowledge graph as a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = ("entities", "edges", "communities")


def save_graph(path: str, entities: DataFrame, edges: DataFrame, communities: DataFrame, kind: str = "parquet") -> None:
    """Write the three tables below `path` (kind: parquet or json); what stood there is replaced."""
    for name, df in zip(PARTS, (entities, edges, communities), strict=True):
        df.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/{name}")


def load_graph(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges, communities."""
    return tuple(spark.read.format(kind).load(f"{path.rstrip('/')}/{name}") for name in PARTS)
