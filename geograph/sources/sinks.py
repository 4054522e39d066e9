"""Writes as DataFrame rewrites: each returns what the target holds afterwards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _paired(target: DataFrame, updates: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = updates.select(*[F.col(c).alias(f"_u_{c}") for c in updates.columns], F.lit(True).alias("_hit"))
    on = [F.col(k).eqNullSafe(F.col(f"_u_{k}")) for k in keys]
    return target.withColumn("_had", F.lit(True)).join(renamed, on, how)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], preserve: dict[str, Column] | None = None) -> DataFrame:
    """Insert rows of new keys and overwrite those of old ones, column by column.

    preserve: column -> condition on the target's row under which its value stays.
    Columns that updates lacks keep their value, null in new rows. updates has each
    key once.
    """
    both = _paired(target, updates, keys, "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    out = []
    for c in target.columns:
        if c in keys:
            value = F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c))
        elif c in updates.columns:
            keep = (preserve or {}).get(c, F.lit(False))
            value = F.when(hit & ~(F.coalesce("_had", F.lit(False)) & F.coalesce(keep, F.lit(False))), F.col(f"_u_{c}")).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.alias(c))
    return both.select(*out)


def seed_merge(target: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows over nodes without undoing later work: rewritten content stays, and
    so does the trust status of merged nodes."""
    rewritten = F.col("content_source") == "ai_enriched"
    return upsert(target, seed, ["node_id"], {"content": rewritten, "content_source": rewritten, "trust_status": F.col("merged_into").isNotNull()})


def update_by_key(target: DataFrame, patch: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Overwrite the patch's columns in rows of its keys. A null in the patch leaves the
    value, or sets null with set_null. Keys that the target lacks do nothing."""
    both = _paired(target, patch, [key], "left")
    new = lambda c: F.when(F.coalesce("_hit", F.lit(False)), F.col(f"_u_{c}")).otherwise(F.col(c)) if set_null else F.coalesce(f"_u_{c}", c)
    return both.select(*[new(c).alias(c) if c in patch.columns and c != key else F.col(c) for c in target.columns])


def replace_for_keys(target: DataFrame, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Drop the target's rows of the given keys and add rows. Other keys' rows stay, even
    if nothing refers to them any more."""
    return target.join(keys.distinct(), keys.columns, "left_anti").unionByName(rows)


def replace_slice(target: DataFrame, predicate: Column, rows: DataFrame) -> DataFrame:
    """Drop the rows that meet the predicate and add rows; a null predicate keeps the row."""
    return target.where(~F.coalesce(predicate, F.lit(False))).unionByName(rows, allowMissingColumns=True)


def insert_with_defaults(df: DataFrame) -> DataFrame:
    """Submissions with a generated id, the current time and status 'pending' where they have none."""
    given = lambda name, default: F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumns({"submission_id": given("submission_id", F.uuid()), "status": given("status", F.lit("pending")), "created_at": given("created_at", F.current_timestamp())})


def write_nodes_json(df: DataFrame, path: str) -> None:
    """Nodes as JSON arrays, one in each part file, as read_nodes_json() reads them. Null
    fields are left out; an empty table gives empty arrays."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            lines = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + x for i, x in enumerate(lines)], pa.string())], names=["value"])
            first = first and not lines
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    rows.mapInArrow(brackets, "value string").write.mode("overwrite").text(path)


def active(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes that are merged into no other; filter and columns reach the scan."""
    kept = nodes.where("merged_into is null")
    return kept.select(*columns) if columns else kept


def graph_snapshot(nodes: DataFrame, clusters: DataFrame, node_clusters: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The four tables of the graph; a graph without active nodes is an error."""
    found = active(nodes)
    if found.isEmpty():
        raise ValueError("the graph is empty; build it first")
    return {"nodes": found, "clusters": clusters, "node_clusters": node_clusters, "edges": edges}


def graph_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The built graph unless it is empty, else the rule-linked one."""
    return fallback if primary.isEmpty() else primary
