"""Registered queries of nodes, edges and merges, and their SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import links, nodes, vectors
from ..operators.staging import settled
from ..sources import sinks
from .queries import _BASE, _BOILER, _COS, _FACTS, _GRAPH, _GROUP, _KNN, _MEMBERS, _PRETTY, _edges, _members, _vectors, flat_nodes, raw_nodes
from .registry import query
from .tables import NODES, derived, table


@query("SELECT c_custkey AS node_id, CASE WHEN c_custkey % 11 = 0 THEN c_custkey ELSE c_custkey - c_custkey % 11 END AS canonical FROM customer")
def canonical_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of merges lead in the end."""
    k = F.col("c_custkey")
    return vectors.resolve_canonical(table(spark, sf_dir, "customer").select(k.alias("node_id"), F.when(k % 11 != 0, k - 1).alias("merged_into")))


@query(f"WITH {_KNN} SELECT source_id, target_id, round(score, 6) AS score FROM c WHERE (source_id + target_id) % 3 <> 0")
def unadjudicated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs that are no edge yet."""
    pairs = vectors.knn_candidates(_vectors(spark, sf_dir)[1])
    return links.unadjudicated(pairs, pairs.where((F.col("source_id") + F.col("target_id")) % 3 == 0)).select("source_id", "target_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE v AS (SELECT *, vec_id // 3 AS t FROM embeddings), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY t ORDER BY vec_id) = 1),
  p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM l a, l b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.40), c AS (SELECT x AS node, x AS r FROM p UNION SELECT p.y, c.r FROM c JOIN p ON p.x = c.node),
  m AS (SELECT node, min(r) AS r FROM c GROUP BY node)
  SELECT v.vec_id AS node_id, CASE WHEN l.vec_id <> v.vec_id THEN l.vec_id WHEN m.r < v.vec_id THEN m.r END AS merged_into, CASE WHEN l.vec_id <> v.vec_id OR m.r < v.vec_id THEN 'merged_duplicate' ELSE 'verified' END AS trust_status FROM v JOIN l USING (t) LEFT JOIN m ON m.node = v.vec_id""")
def two_pass_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by title, then, among what is left, by vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.concat(F.lit("Site No "), F.floor(F.col("vec_id") / 3)).alias("title"), F.lit(None).cast("long").alias("merged_into"), F.lit("verified").alias("trust_status"), "embedding")
    n = nodes.merge_titles(v)
    pairs = vectors.similar_links(n.where("merged_into is null").select("node_id", "embedding"), 0.40)
    merged = vectors.merged_components(pairs).select("node_id", F.col("canonical").alias("merged_into"), F.lit("merged_duplicate").alias("trust_status"))
    return sinks.update_by_key(n, merged, "node_id").select("node_id", "merged_into", "trust_status")


@query(f"WITH {_FACTS} SELECT id, 'Title: ' || title || '; Category: ' || {_PRETTY} || '; District: ' || coalesce(place, 'unknown') || '; Era: ' || coalesce(nullif(era, ''), 'unspecified') || '; Content: ' || coalesce(docent_details, '') AS line FROM f")
def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line on each node for a prompt."""
    n = flat_nodes(spark, sf_dir).withColumns({"district": F.col("place"), "content": F.col("docent_details")})
    return n.select("id", nodes.describe().alias("line"))


@query(f"WITH {_BASE} SELECT id, title, category, {_GROUP} AS heritage_group, CASE WHEN pos % 50 <> 7 THEN lat END AS lat, lng, era, famous_for, nearby_culture, docent_details, trust, photo FROM n")
def flattened_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested nodes with flat names."""
    return nodes.flatten_nodes(raw_nodes(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT 'edge-' || source_id || '-' || target_id AS id, source_id AS source, target_id AS target, tier, round(score, 6) AS score FROM e")
def shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges under the names that displays use."""
    n, e = _edges(spark, sf_dir)
    named = n.withColumns({"node_id": F.col("id"), "latitude": F.col("lat"), "longitude": F.col("lng"), "trust_status": F.col("trust"), "district": F.col("place"), "content": F.col("docent_details"), "content_source": F.lit("original"), "photo_url": F.col("photo"), "subtype_id": F.lit(None).cast("string"), "subtype_name": F.lit(None).cast("string")})
    identified = e.withColumn("edge_id", F.concat_ws("-", "source_id", "target_id"))
    return links.to_graph_shape(named, identified)[1].select("id", "source", "target", "tier", F.round("score", 6).alias("score"))


@query(f"WITH {_FACTS} SELECT id, title, heritage_group AS \"group\", lat, lng, coalesce(place, '') AS place, coalesce(photo, '') AS photo FROM f")
def shown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes under the names that displays use."""
    n = flat_nodes(spark, sf_dir)
    named = n.withColumns({"node_id": F.col("id"), "latitude": F.col("lat"), "longitude": F.col("lng"), "trust_status": F.col("trust"), "district": F.col("place"), "content": F.col("docent_details"), "content_source": F.lit("original"), "photo_url": F.col("photo"), "subtype_id": F.lit(None).cast("string"), "subtype_name": F.lit(None).cast("string")})
    none = spark.createDataFrame([], "edge_id long, source_id string, target_id string, tier string, score double, rationale string")
    return links.to_graph_shape(named, none)[0].select("id", "title", "group", "lat", "lng", F.coalesce("place", F.lit("")).alias("place"), F.coalesce("photo", F.lit("")).alias("photo"))


@query(f"WITH {_BASE} SELECT id, CASE WHEN pos % 4 = 1 THEN 'About ' || title ELSE 'seed' END AS content, CASE WHEN pos % 4 = 1 THEN 'ai_enriched' ELSE 'original' END AS content_source, pos % 4 <> 1 AS has_vector FROM n")
def rewritten_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New descriptions as content; rewritten nodes lose their vector, and blank ones do nothing."""
    p = F.col("pos")
    n = derived(spark, sf_dir, NODES).select("pos", "title", F.col("id").alias("node_id"), F.lit("seed").alias("content"), F.lit("original").alias("content_source"), F.array(F.lit(1.0)).cast("array<float>").alias("vector_embedding"))
    new = n.where(p % 2 == 1).select("node_id", F.when(p % 4 == 1, F.concat(F.lit("  About "), "title", F.lit(" "))).otherwise("   ").alias("description"))
    done = nodes.apply_rewrites(n, new)
    return done.select(F.col("node_id").alias("id"), "content", "content_source", F.col("vector_embedding").isNotNull().alias("has_vector"))


_BOILER_FIRST = f"WITH {_FACTS} SELECT id FROM f WHERE {_BOILER} AND pos % 4 <> 0 ORDER BY id LIMIT 25"


@query(_BOILER_FIRST)
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nodes, by id, whose texts are boilerplate: a bounded run's work."""
    n = flat_nodes(spark, sf_dir).withColumns({"node_id": F.col("id"), "merged_into": F.lit(None), "content_source": F.when(F.col("pos") % 4 == 0, "ai_enriched").otherwise("original")})
    return nodes.enrich_candidates(n, 25).select("id")


@query(f"WITH {_BASE} SELECT id FROM n WHERE pos % 6 <> 2 AND pos % 4 = 1")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active nodes without a vector."""
    p = F.col("pos")
    n = derived(spark, sf_dir, NODES).select("id", F.when(p % 6 == 2, "N0").alias("merged_into"), F.when(p % 4 != 1, F.array(F.lit(1.0))).alias("vector_embedding"))
    return nodes.embed_pending(n).select("id")


@query(f"""WITH {_GRAPH}, {_MEMBERS.partition(", m AS")[1][2:]}{_MEMBERS.partition(", m AS")[2]}
  SELECT 'nodes' AS "table", id AS key, id || '|' || heritage_group AS row FROM f WHERE pos % 6 <> 2
  UNION ALL SELECT 'clusters', cluster_id, kind || '|' || arg_max(coalesce(parent_id, ''), node_id) FROM m GROUP BY cluster_id, kind
  UNION ALL SELECT 'node_clusters', node_id || '|' || cluster_id, '' FROM m
  UNION ALL SELECT 'edges', source_id || '|' || target_id, tier FROM e
  UNION ALL SELECT 'fallback', source_id || '|' || target_id, tier FROM e""")
def graph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the graph's four tables, and the rule-linked edges where no edge was built."""
    n, e = _edges(spark, sf_dir)
    own = n.select(F.col("id").alias("node_id"), "heritage_group", F.when(F.col("pos") % 6 == 2, "N0").alias("merged_into"))
    members = settled(_members(spark, sf_dir))
    found = sinks.graph_snapshot(own, nodes.build_clusters(members), members.select("node_id", "cluster_id"), settled(e))
    none = spark.createDataFrame([], e.schema)
    pair = lambda a, b: F.concat_ws("|", a, b)
    rows = {
        "nodes": found["nodes"].select(F.col("node_id").alias("key"), pair("node_id", "heritage_group").alias("row")),
        "clusters": found["clusters"].select(F.col("cluster_id").alias("key"), pair("kind", F.coalesce("parent_id", F.lit(""))).alias("row")),
        "node_clusters": found["node_clusters"].select(pair("node_id", "cluster_id").alias("key"), F.lit("").alias("row")),
        "edges": found["edges"].select(pair("source_id", "target_id").alias("key"), F.col("tier").alias("row")),
        "fallback": sinks.graph_or_fallback(none, found["edges"]).select(pair("source_id", "target_id").alias("key"), F.col("tier").alias("row")),
    }
    out = [df.select(F.lit(name).alias("table"), "key", "row") for name, df in rows.items()]
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {_BASE} SELECT id AS node_id, title FROM n WHERE pos % 6 <> 2")
def active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are merged into no other."""
    n = derived(spark, sf_dir, NODES).select(F.col("id").alias("node_id"), "title", F.when(F.col("pos") % 6 == 2, "N0").alias("merged_into"))
    return sinks.active(n, "node_id", "title")


@query(f"WITH {_BASE}, k AS (SELECT pos, CASE WHEN pos % 50 <> 7 THEN lat END AS lat, lng, {_GROUP} AS g FROM n) SELECT g AS heritage_group, count(*) AS nodes, round(avg(lat), 6) AS lat FROM k GROUP BY g")
def group_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and mean latitude of each group."""
    raw = raw_nodes(spark, sf_dir).withColumn("heritage_group", tx.group_of("category"))
    return raw.groupBy("heritage_group").agg(F.count("*").alias("nodes"), F.round(F.avg("coordinates.lat"), 6).alias("lat"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next one, as an expression."""
    v = table(spark, sf_dir, "embeddings")
    a, b = (v.select((F.col("vec_id") + shift).alias("k"), F.col("vec_id").alias(n), F.col("embedding").alias(f"v_{n}")) for n, shift in (("a", 1), ("b", 0)))
    return a.join(b, "k").select("a", "b", F.round(vectors.cosine("v_a", "v_b"), 6).alias("similarity"))
