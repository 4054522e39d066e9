"""Audits of the tables' constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(rows: DataFrame, table: str, rule: str, key: Column) -> DataFrame:
    return rows.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def duplicates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    return _found(df.groupBy(*keys).count().where("count > 1"), table, f"unique({','.join(keys)})", F.concat_ws("|", *keys))


def nulls(df: DataFrame, table: str, column: str, key: str) -> DataFrame:
    return _found(df.where(F.col(column).isNull()), table, f"not_null({column})", F.col(key))


def breaks(df: DataFrame, table: str, rule: str, holds: Column, key: str) -> DataFrame:
    """Rows for which a check is false; unknown passes, as it does in SQL."""
    return _found(df.where(~F.coalesce(holds, F.lit(True))), table, rule, F.col(key))


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    wanted = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
    return _found(wanted.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti").distinct(), table, f"references({column})", F.col("_k"))


def audit_constraints(nodes: DataFrame, clusters: DataFrame, node_clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """table, rule, key of each violation."""
    checks = [
        duplicates(nodes, "nodes", ["node_id"]),
        nulls(nodes, "nodes", "title", "node_id"),
        orphans(nodes, "nodes", "merged_into", nodes, "node_id"),
        duplicates(clusters, "clusters", ["cluster_id"]),
        orphans(clusters, "clusters", "parent_id", clusters, "cluster_id"),
        duplicates(node_clusters, "node_clusters", ["node_id", "cluster_id"]),
        orphans(node_clusters, "node_clusters", "node_id", nodes, "node_id"),
        orphans(node_clusters, "node_clusters", "cluster_id", clusters, "cluster_id"),
        duplicates(edges, "edges", ["source_id", "target_id"]),
        breaks(edges, "edges", "source_id < target_id", F.col("source_id") < F.col("target_id"), "source_id"),
        orphans(edges, "edges", "source_id", nodes, "node_id"),
        orphans(edges, "edges", "target_id", nodes, "node_id"),
    ]
    return reduce(DataFrame.unionByName, checks)
