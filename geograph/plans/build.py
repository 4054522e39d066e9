"""The bulk build of the graph: named steps over persisted tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import links, nodes, vectors
from ..operators.staging import settled
from ..sources.schemas import CLUSTERS, EDGES, NODE_CLUSTERS, NODES, VERDICTS
from ..sources.sinks import replace_for_keys, seed_merge, update_by_key, upsert


class GraphTables:
    """The graph's tables as Parquet folders under one shared folder.

    A table is replaced by moving: the new rows are written whole beside it, then the old
    folder is moved away, the new one into its place, and the old one is deleted. A
    job that is lost anywhere in between leaves a whole table, which the next access
    puts back into its place. One job writes a table at a time.
    """

    SCHEMAS = {"nodes": NODES, "clusters": CLUSTERS, "node_clusters": NODE_CLUSTERS, "edges": EDGES, "verdicts": VERDICTS}

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str, state: str = "") -> str:
        return f"{self.base}/_{name}.{state}" if state else f"{self.base}/{name}"

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} cannot be moved to {new}")

    def _drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _mend(self, name: str) -> bool:
        """Put a table that was left half replaced into its place; whether there is one."""
        own, new, old = self._at(name), self._at(name, "new"), self._at(name, "old")
        if not self._there(own):
            if self._there(f"{new}/_SUCCESS"):
                self._move(new, own)
            elif self._there(old):
                self._move(old, own)
        return self._there(own)

    def read(self, name: str) -> DataFrame:
        """The table; an empty one if none was ever written."""
        if self._mend(name):
            return self.spark.read.schema(self.SCHEMAS[name]).parquet(self._at(name))
        return self.spark.createDataFrame([], self.SCHEMAS[name])

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.SCHEMAS[name])])

    def write(self, name: str, df: DataFrame, **metrics: str) -> dict[str, int]:
        """Replace the table; its rows may come from the table itself. Returns `rows` and
        the metrics (rows that meet a condition), observed while it is written."""
        own, new, old = self._at(name), self._at(name, "new"), self._at(name, "old")
        self._mend(name)
        counts, full = observed(self._shaped(name, df), **metrics)
        full.write.mode("overwrite").parquet(new)
        self._drop(old)
        if self._there(own):
            self._move(own, old)
        self._move(new, own)
        self._drop(old)
        return counts.get

    def append(self, name: str, df: DataFrame) -> int:
        """Add rows; they are there in full or not at all. Returns their number."""
        self._mend(name)
        counts, full = observed(self._shaped(name, df))
        full.write.mode("append").parquet(self._at(name))
        return counts.get["rows"]


def observed(df: DataFrame, **metrics: str) -> tuple[Observation, DataFrame]:
    """df, whose rows, and those that meet the metrics' conditions, are counted when it is computed."""
    counts = Observation()
    return counts, df.observe(counts, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(name) for name, c in metrics.items()])


def counted(df: DataFrame, **metrics: str) -> tuple[dict[str, int], DataFrame]:
    """What observed() counts, and df, computed once and kept."""
    counts, full = observed(df, **metrics)
    kept = settled(full)
    return counts.get, kept


ACTIVE, ENRICHED, EMBEDDED = "merged_into is null", "content_source = 'ai_enriched'", "vector_embedding is not null"


def seed(t: GraphTables, raw: DataFrame) -> dict[str, int]:
    seen, rows = observed(raw)
    usable, found = observed(nodes.normalize_nodes(rows))
    written = t.write("nodes", seed_merge(t.read("nodes"), found))
    return {"seen": seen.get["rows"], "skipped": seen.get["rows"] - usable.get["rows"], "nodes": written["rows"]}


def enrich(t: GraphTables, rewrite: Callable[[DataFrame], DataFrame] | None) -> dict[str, int]:
    """rewrite: candidates -> (node_id, description); None leaves all as it is."""
    if not rewrite:
        return {"seen": 0, "rewritten": 0, "skipped": 0}
    asked, candidates = counted(nodes.enrich_candidates(t.read("nodes")))
    before, n = observed(t.read("nodes"), enriched=ENRICHED)
    done = t.write("nodes", nodes.apply_rewrites(n, rewrite(candidates)), enriched=ENRICHED)["enriched"] - before.get["enriched"]
    return {"seen": asked["rows"], "rewritten": done, "skipped": asked["rows"] - done}


def embed(t: GraphTables) -> dict[str, int]:
    asked, pending = counted(nodes.embed_pending(t.read("nodes")).select("node_id", "content"))
    before, n = observed(t.read("nodes"), embedded=EMBEDDED)
    done = t.write("nodes", update_by_key(n, vectors.embed(pending, "content", out_col="vector_embedding").drop("content"), "node_id"), embedded=EMBEDDED)
    return {"seen": asked["rows"], "embedded": done["embedded"] - before.get["embedded"]}


def dedupe(t: GraphTables, verdicts: DataFrame | None, least: float = vectors.DUPLICATE_FROM) -> dict[str, int]:
    """By title, then, among what is left, by vectors and verdicts."""
    before, rows = observed(t.read("nodes"), active=ACTIVE)
    titled, n = counted(nodes.merge_titles(rows), active=ACTIVE)
    if verdicts is not None:
        left = n.where("merged_into is null and vector_embedding is not null").select("node_id", F.col("vector_embedding").alias("embedding"))
        merged = vectors.semantic_dedupe(left, verdicts, least).select("node_id", F.col("canonical").alias("merged_into"), F.lit("merged_duplicate").alias("trust_status"))
        n = update_by_key(n, merged, "node_id")
    after = t.write("nodes", n, active=ACTIVE)
    seen = before.get["active"]
    return {"seen": seen, "merged_by_title": seen - titled["active"], "merged_by_vector": titled["active"] - after["active"]}


def cluster(t: GraphTables) -> dict[str, int]:
    """Clusters are upserted; the memberships of active nodes are written anew."""
    own = t.read("nodes").where("merged_into is null")
    members = nodes.memberships(own)
    clusters = t.write("clusters", upsert(t.read("clusters"), nodes.build_clusters(members), ["cluster_id"]))
    held = t.write("node_clusters", replace_for_keys(t.read("node_clusters"), own.select("node_id"), members.select("node_id", "cluster_id")))
    return {"seen": own.count(), "clusters": clusters["rows"], "memberships": held["rows"]}


#: Batches of pairs whose verdicts are committed at a time.
JUDGED_AT_ONCE = 200


def link(t: GraphTables, judge: Callable[[DataFrame], DataFrame] | None, k: int = vectors.NEIGHBOURS, least: float = vectors.LEAST_COSINE) -> dict[str, int]:
    """judge: numbered pairs -> verdicts (batch, index, connect, tier, rationale).

    Verdicts are committed group by group, some batches each, before the next group is
    asked; then the edges that they form are. A run that fails keeps what was judged,
    and the next one asks only for pairs that are no edge and have no verdict. Pairs
    whose verdict is missing in a reply are asked again by the next run.
    """
    if not judge:
        return {"seen": 0, "formed": 0, "skipped": 0}
    own = t.read("nodes").where("merged_into is null and vector_embedding is not null").select("node_id", F.col("vector_embedding").alias("embedding"))
    pairs = links.unadjudicated(links.unadjudicated(vectors.knn_candidates(own, k, least), t.read("edges")), t.read("verdicts"))
    seen, numbered = counted(links.number_batches(pairs))
    groups = -(-numbered.select("batch").distinct().count() // JUDGED_AT_ONCE)
    for g in range(groups):
        part = numbered.where(F.pmod(F.xxhash64("batch"), F.lit(groups)) == g)
        t.append("verdicts", part.join(judge(part), ["batch", "index"]))
    formed, _ = links.form_edges(links.unadjudicated(t.read("verdicts"), t.read("edges")))
    made, formed = counted(formed)
    t.write("edges", upsert(t.read("edges"), formed.withColumn("edge_id", F.xxhash64("source_id", "target_id")), ["source_id", "target_id"]))
    return {"seen": seen["rows"], "formed": made["rows"], "skipped": seen["rows"] - made["rows"]}


STEPS = ["seed", "enrich", "embed", "dedupe", "cluster", "link"]


def run(t: GraphTables, raw: DataFrame, rewrite=None, verdicts: DataFrame | None = None, judge=None, first: str | None = None, only: str | None = None) -> dict[str, dict[str, float]]:
    """Seconds and counts (rows seen, merged, formed, skipped ...) of each step run: all,
    those from `first` on, or `only` one. The first failure stops the job; steps
    before it stay done, and each may run again."""
    calls = {"seed": lambda: seed(t, raw), "enrich": lambda: enrich(t, rewrite), "embed": lambda: embed(t), "dedupe": lambda: dedupe(t, verdicts), "cluster": lambda: cluster(t), "link": lambda: link(t, judge)}
    for name in (first, only):
        if name is not None and name not in STEPS:
            raise ValueError(f"no step {name}; steps: {STEPS}")
    chosen = [only] if only else STEPS[STEPS.index(first) :] if first else STEPS
    took = {}
    for name in chosen:
        began = time.time()
        counts = calls[name]()
        took[name] = {"seconds": time.time() - began, **counts}
    return took
