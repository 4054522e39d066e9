"""The registered queries of the place graph and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions import text as tx
from ..operators import geofence, links, nodes, quality, review, vector_index, vectors
from ..operators.staging import settled, spread, written
from ..sources import readers, sinks
from .registry import query
from .tables import FENCES, NODES, SCANS, SUBMISSIONS, derived, duck, table

def flat_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their facts. They are dealt out first: facts take many patterns a row, and small files or a small join leave them to few tasks."""
    return nodes.with_facts(spread(derived(spark, sf_dir, NODES), "pos").withColumn("heritage_group", tx.group_of("category")))


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as the nested feeds have them; some lack a coordinate."""
    n = derived(spark, sf_dir, NODES)
    point = F.struct(F.when(F.col("pos") % 50 != 7, F.col("lat")).alias("lat"), "lng")
    return n.select(F.col("id").alias("node_id"), "title", "category", point.alias("coordinates"), "era", "famous_for", "docent_details", "nearby_culture", F.col("trust").alias("trust_status"), F.struct(F.col("photo").alias("photo_url")).alias("media"), "pos")


# SQL shared by the oracles.
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\(.*?\\)', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains(" + _LIST(tx.STOP_WORDS) + ", w))"
_TOKENS = "list_filter(" + _WORDS + ", lambda w: length(w) >= 4 AND NOT list_contains(" + _LIST(tx.GENERIC_TITLE_WORDS) + ", w))"
_KNOWN = "list_filter(" + _LIST(tx.KNOWN_PLACES) + ", lambda p: contains({0}, p))[1]"
_ORIGIN = "nullif(lower(trim(regexp_extract(coalesce(docent_details, ''), '(?i)officially originates from ([^.]+)\\.', 1))), '')"
_PLACE = "coalesce(nullif(lower(trim(regexp_extract(coalesce(famous_for, ''), '(?i)located in the ([A-Za-z\\s]+?) district', 1))), ''), " + _KNOWN.format(_ORIGIN) + ", " + _ORIGIN + ", " + _KNOWN.format("lower(coalesce(title, ''))") + ")"
_GI = "nullif(lower(trim(regexp_extract(coalesce(docent_details, ''), 'Type:\\s*([A-Z\\s]+)\\.', 1))), '')"
_ERA = "CASE WHEN trim(coalesce(era, '')) <> '' AND NOT list_contains(" + _LIST(tx.GENERIC_ERAS) + ", lower(trim(era))) THEN trim(era) END"
_GROUP = "CASE WHEN upper(coalesce(category, '')) LIKE 'INTANGIBLE%' THEN 'intangible' WHEN upper(coalesce(category, '')) LIKE 'GASTRONOMY%' THEN 'gastro' ELSE 'tangible' END"
_BOILER = "(" + " OR ".join(f"regexp_matches({f}, '(?i){p}')" for f in ("coalesce(famous_for, '')", "coalesce(docent_details, '')") for p in tx.BOILERPLATE) + " OR length(trim(coalesce(famous_for, '') || ' ' || coalesce(docent_details, ''))) < 40)"
_PRETTY = "CASE WHEN coalesce(category, '') = '' THEN 'Heritage Site' ELSE array_to_string(list_transform(string_split(category, '_'), lambda w: CASE WHEN w IN ('ASI', 'GI') THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') END"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))))"
_BASE = "n AS (" + duck(NODES) + ")"
_FACTS = _BASE + f", f AS (SELECT *, {_GROUP} AS heritage_group, {_PLACE} AS place, {_ERA} AS era_fact, {_GI} AS gi_fact, {_NORM.format('title')} AS norm_title, list_distinct({_TOKENS.format('title')}) AS tokens FROM n)"
_CENTURY = "try_cast(nullif(regexp_extract(coalesce(era, ''), '(?i)(\\d{1,2})(?:st|nd|rd|th)\\s+century', 1), '') AS INTEGER)"
_BAND = f"CASE WHEN regexp_matches(coalesce(era, ''), '(?i)\\bancient\\b') OR {_CENTURY} <= 6 THEN 'era-ancient' WHEN {_CENTURY} <= 14 THEN 'era-early-medieval' WHEN {_CENTURY} <= 18 THEN 'era-rajput-mughal' WHEN {_CENTURY} = 19 THEN 'era-colonial' WHEN {_CENTURY} IS NOT NULL THEN 'era-modern' ELSE 'era-undated' END"
_SUBTYPE = "CASE category " + " ".join(f"WHEN '{c}' THEN '{k}'" for k, (_, cs) in taxonomy.SUBTYPES.items() for c in cs) + f" ELSE '{taxonomy.OTHER_SUBTYPE}' END"
_CRAFT = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), '{'|'.join(ws)}') THEN '{k}'" for k, _, ws in taxonomy.CRAFTS) + " END"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"WITH {_FACTS} SELECT id, place, gi_fact, era_fact, norm_title, heritage_group, array_to_string(list_sort(tokens), ',') AS tokens, {_PRETTY} AS pretty, {_BOILER} AS boilerplate FROM f")
def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, tokens and predicates read from node texts."""
    n = flat_nodes(spark, sf_dir)
    return n.select("id", "place", "gi_fact", "era_fact", "norm_title", "heritage_group", F.array_join(F.array_sort(tx.title_tokens("title")), ",").alias("tokens"), tx.pretty_category("category").alias("pretty"), tx.is_boilerplate("famous_for", "docent_details").alias("boilerplate"))


@query("SELECT doc_id, CAST(len(" + _WORDS.format("text") + ") AS BIGINT) AS n_tokens, CAST(len(list_distinct(" + _TOKENS.format("text") + ")) AS BIGINT) AS n_title_tokens FROM documents")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens("text")).cast("long").alias("n_tokens"), F.size(tx.title_tokens("text")).cast("long").alias("n_title_tokens"))


@query(f"WITH {_BASE}, k AS (SELECT id, {_NORM.format('title')} AS t FROM n) SELECT id, CASE WHEN t = '' THEN id ELSE min(id) OVER (PARTITION BY t) END AS canonical, t <> '' AND min(id) OVER (PARTITION BY t) <> id AS is_merged FROM k")
def title_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with equal normal titles."""
    return nodes.title_dedupe(derived(spark, sf_dir, NODES).select("id", "title"), "id").select("id", "canonical", "is_merged")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.first_per_key(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], ["n_chars", "doc_id"]).drop("n_chars")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.memberships(flat_nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "title", "category", "heritage_group", "era", F.col("place").alias("district")))


_MEMBERS = f"""{_FACTS}, m AS (
  SELECT id AS node_id, 'root-rajasthan' AS cluster_id, 'root' AS kind, NULL AS parent_id FROM f
  UNION ALL SELECT id, 'heritage-' || heritage_group, 'heritage_type', 'root-rajasthan' FROM f
  UNION ALL SELECT id, {_SUBTYPE}, 'subtype', 'heritage-' || heritage_group FROM f
  UNION ALL SELECT id, {_BAND}, 'era_band', 'root-rajasthan' FROM f
  UNION ALL SELECT id, 'district-' || {_SLUG.format("place")}, 'district', 'root-rajasthan' FROM f WHERE coalesce(place, '') <> ''
  UNION ALL SELECT id, {_CRAFT}, 'craft_family', NULL FROM f WHERE {_CRAFT} IS NOT NULL)"""


@query(f"WITH {_MEMBERS} SELECT node_id, cluster_id, kind, parent_id FROM m")
def cluster_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("node_id", "cluster_id", "kind", "parent_id")


@query(f"WITH {_MEMBERS} SELECT cluster_id, kind, arg_max(coalesce(parent_id, ''), node_id) AS parent_id FROM m GROUP BY cluster_id, kind")
def cluster_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.build_clusters(_members(spark, sf_dir)).select("cluster_id", "kind", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@query(f"WITH {_FACTS} SELECT id AS node_id, {_SUBTYPE} AS subtype_id FROM f")
def node_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    own = flat_nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "category")
    return nodes.node_subtype(own, members.where("substr(node_id, 10) <> '7'").select("node_id", "cluster_id"), nodes.build_clusters(members)).select("node_id", "subtype_id")


@query(f"WITH {_BASE} SELECT a.pos AS a, b.pos AS b, round({_KM.format('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 6) AS km FROM n a JOIN n b ON a.pos < b.pos AND {_KM.format('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 15")
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.radius_pairs(derived(spark, sf_dir, NODES).select("pos", "lat", "lng"), 15, decimals=6)


_PAIRS = f"""{_FACTS}, p AS (
  SELECT a.pos AS a, b.pos AS b, a.id AS a_id, b.id AS b_id, a.place AS a_place, b.place AS b_place, a.era_fact AS a_era, b.era_fact AS b_era, a.gi_fact AS a_gi, b.gi_fact AS b_gi,
    a.norm_title AS a_norm, b.norm_title AS b_norm, a.heritage_group AS a_group, b.heritage_group AS b_group,
    {_KM.format('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km, len(list_intersect(a.tokens, b.tokens)) AS shared
  FROM f a JOIN f b ON a.pos < b.pos
), r AS (
  SELECT *, CASE WHEN a_norm <> '' AND a_norm = b_norm THEN 1 WHEN a_place <> '' AND a_place = b_place AND km <= 120 THEN 2 WHEN a_era = b_era THEN 3
    WHEN a_gi = b_gi AND a_place IS DISTINCT FROM b_place THEN 4 WHEN km <= 60 AND shared > 0 THEN 5 WHEN a_group = b_group AND km <= 15 THEN 6 END AS rule FROM p
), c AS (
  SELECT a, b, a_id, b_id, rule, CASE WHEN rule = 1 THEN 'verified' WHEN rule <= 3 THEN 'source_supported' ELSE 'potential' END AS tier,
    CASE rule WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE + 0.1::DOUBLE WHEN 3 THEN 0.8::DOUBLE + 0.05::DOUBLE WHEN 4 THEN 0.55::DOUBLE WHEN 5 THEN least(0.35::DOUBLE + shared * 0.05::DOUBLE, 0.55::DOUBLE)
      ELSE greatest(0.12::DOUBLE, 0.26::DOUBLE - km / 15 * 0.14::DOUBLE) END AS score FROM r WHERE rule IS NOT NULL
)"""


@query(f"WITH {_PAIRS} SELECT rule, tier, count(*) AS pairs, round(sum(score), 3) AS score FROM c GROUP BY rule, tier")
def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the first rule that links them."""
    return links.candidate_counts(flat_nodes(spark, sf_dir)).withColumn("score", F.round("score", 3))


_GRAPH = f"""{_PAIRS}, t AS (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, other) AS n FROM (SELECT a AS own, b AS other, * FROM c UNION ALL SELECT b, a, * FROM c)
), e AS (SELECT DISTINCT least(a_id, b_id) AS source_id, greatest(a_id, b_id) AS target_id, tier, score FROM t WHERE n <= 4)"""


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = flat_nodes(spark, sf_dir)
    return n, links.link_graph(n)


@query(f"WITH {_GRAPH} SELECT source_id, target_id, tier, round(score, 6) AS score FROM e")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-linked graph: each node's four best links."""
    return _edges(spark, sf_dir)[1].select("source_id", "target_id", "tier", F.round("score", 6).alias("score"))


_SHARED = "list_filter(list_filter({0}, lambda w, i: list_position({0}, w) = i), lambda w: list_contains({1}, w))".format(_TOKENS.format("x.title"), "y.tokens")


@query(f"""WITH {_GRAPH}, l AS (SELECT DISTINCT a, b, rule FROM t WHERE n <= 4), w AS (
  SELECT x.id AS i, y.id AS o, rule, x.place, x.era_fact, x.gi_fact, x.heritage_group, {_KM.format('x.lat', 'x.lng', 'y.lat', 'y.lng')} AS km, {_SHARED} AS words FROM l JOIN f x ON x.pos = l.a JOIN f y ON y.pos = l.b)
  SELECT least(i, o) AS source_id, greatest(i, o) AS target_id, CASE rule WHEN 1 THEN 'Duplicate archival record of the same documented subject.'
    WHEN 2 THEN 'Both officially registered/protected under "' || place || '" — a shared, sourced administrative fact.' WHEN 3 THEN 'Both dated to the same documented era — "' || era_fact || '".'
    WHEN 4 THEN 'Same craft/produce classification ("' || gi_fact || '") from a different town — a possible cross-regional technique lineage. Not established as historically linked by current sources; flagged as a research lead.'
    WHEN 5 THEN 'Share the keyword' || CASE WHEN len(words) > 1 THEN 's' ELSE '' END || ' "' || array_to_string(words[1:3], ', ') || '" in their titles. A direct relationship is not established by current sources; flagged as a research lead.'
    ELSE 'Both ' || heritage_group || ' heritage nodes ' || printf('%.1f', km) || ' km apart with no documented link yet — proximity-only research lead.' END AS rationale FROM w""")
def link_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the nodes of each edge are linked."""
    return _edges(spark, sf_dir)[1].select("source_id", "target_id", "rationale")


@query(f"WITH {_GRAPH}, b AS (SELECT source_id AS i FROM e UNION ALL SELECT target_id FROM e), d AS (SELECT i, count(*) AS k FROM b GROUP BY i) SELECT id AS node_id, coalesce(k, 0) AS degree, round(4 + 2.6 * sqrt(coalesce(k, 0)), 6) AS radius FROM n LEFT JOIN d ON i = id")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _edges(spark, sf_dir)
    return links.degree(n.select(F.col("id").alias("node_id")), e).withColumn("radius", F.round("radius", 6))


@query(f"WITH {_GRAPH}, b AS (SELECT source_id AS i, target_id AS o FROM e UNION ALL SELECT target_id, source_id FROM e) SELECT i AS node_id, string_agg(DISTINCT o, ',' ORDER BY o) AS neighbours FROM b GROUP BY i")
def node_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.adjacency(_edges(spark, sf_dir)[1]).select("node_id", F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {_GRAPH}, b AS (SELECT source_id AS i, target_id AS o, tier FROM e UNION ALL SELECT target_id, source_id, tier FROM e) SELECT i AS node_id, tier, string_agg(o, ',' ORDER BY o) AS others FROM b JOIN n ON n.id = b.o WHERE tier <> 'contradictory' GROUP BY i, tier")
def node_edges_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _edges(spark, sf_dir)
    return links.edges_by_tier(n.select(F.col("id").alias("node_id"), "title"), e).select("node_id", "tier", F.array_join("others", ",").alias("others"))


@query(f"WITH {_GRAPH} SELECT t.tier, count(e.tier) AS edges FROM (VALUES ('verified'), ('source_supported'), ('potential')) t(tier) LEFT JOIN e ON e.tier = t.tier GROUP BY t.tier")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.tier_counts(_edges(spark, sf_dir)[1])


@query(f"WITH {_GRAPH} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.graph_totals(*_edges(spark, sf_dir))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")
    return v.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding"), v


_MATCH = f"SELECT a.vec_id AS query_id, b.vec_id AS node_id, round({_COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 3"


@query(_MATCH)
def vector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most similar nodes of each query."""
    q, v = _vectors(spark, sf_dir)
    return vectors.best_matches(q, v, 3, skip_same=True).withColumn("similarity", F.round("similarity", 6))


_KNN = f"WITH k AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.35) SELECT least(x, y) AS source_id, greatest(x, y) AS target_id, round(max(s), 6) AS score FROM k WHERE r <= 6 GROUP BY ALL"


@query(_KNN)
def knn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)[1]
    return vectors.knn_candidates(v).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.label = b.label AND {_COS} >= 0.40),
  c AS (SELECT x AS node, x AS r FROM p UNION SELECT p.y, c.r FROM c JOIN p ON p.x = c.node) SELECT node AS node_id, min(r) AS canonical FROM c GROUP BY node HAVING min(r) < node""")
def semantic_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors of one label, merged by components; the label stands for the judge."""
    return vectors.merged_components(vectors.similar_links(_vectors(spark, sf_dir)[1], 0.40, "label"))


@query(_MATCH)
def index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_match from the inverted file: four cells, and then those that may hold a better row."""
    q, v = _vectors(spark, sf_dir)
    found = vector_index.search(vector_index.build(v), q, 3, 4, exact=True, skip_same=True)
    return found.select("query_id", "node_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(_KNN)
def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_candidates from the inverted file."""
    found = vector_index.knn_candidates(vector_index.build(_vectors(spark, sf_dir)[1]))
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_COS} >= 0.40")
def index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a cosine of 0.40, from cells that may hold one."""
    found = vector_index.similar_pairs(vector_index.build(_vectors(spark, sf_dir)[1]), 0.40)
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's ten most similar nodes are among those that probing finds, when
    as many cells are read as 95 % of the sampled rows' neighbours need."""
    q, v = _vectors(spark, sf_dir)
    index = vector_index.build(v)
    found = vector_index.search(index, q, 10, vector_index.probes_for(index), skip_same=True).select("query_id", "node_id", F.lit(1).alias("hit"))
    best = vectors.best_matches(q, v, 10, skip_same=True).select("query_id", "node_id")
    return best.join(found, ["query_id", "node_id"], "left").groupBy("query_id").agg(F.count("*").alias("best"), F.count("hit").alias("found"))


@query(f"""WITH m AS (SELECT a.vec_id AS q, b.vec_id AS i, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
  g AS (SELECT q, max(s) AS top, string_agg('Title: T' || i || chr(10) || 'Content: ' || CAST((SELECT label FROM embeddings e WHERE e.vec_id = m.i) AS VARCHAR), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS t FROM m WHERE r <= 3 GROUP BY q)
  SELECT q AS query_id, top < 0.40 AS refused, round(top, 6) AS top_similarity, CASE WHEN top >= 0.40 THEN t END AS context FROM g""")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each query, or its refusal."""
    q, v = _vectors(spark, sf_dir)
    there = v.select("node_id", F.concat(F.lit("T"), "node_id").alias("title"), F.col("label").cast("string").alias("content"), "embedding")
    return vectors.answers(q.withColumn("user_query", F.lit("what is here?")), there, 3, 0.40, skip_same=True).select("query_id", "refused", F.round("top_similarity", 6).alias("top_similarity"), "context")


@query(f"""WITH s AS ({duck(SCANS)}), f AS ({duck(FENCES)}), e AS (SELECT *, sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM s),
  d AS (SELECT e.*, f.node_id, {_KM.format('e.latitude', 'e.longitude', 'f.lat', 'f.lng')} AS km FROM e, f WHERE NOT is_reset),
  z AS (SELECT *, CASE WHEN km <= radius_km THEN 'IN' WHEN km > radius_km + 12 THEN 'OUT' END AS zone FROM d),
  l AS (SELECT *, last_value(zone IGNORE NULLS) OVER (PARTITION BY session_id, epoch, node_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM z),
  h AS (SELECT *, CASE WHEN zone = 'IN' THEN CASE WHEN was = 'IN' THEN 'INSIDE' ELSE 'ENTERED' END WHEN zone = 'OUT' THEN 'EXITED' END AS clear FROM l),
  t AS (SELECT *, coalesce(last_value(clear IGNORE NULLS) OVER (PARTITION BY session_id, epoch, node_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'EXITED') AS state FROM h)
  SELECT session_id, event_id, node_id, round(km, 2) AS distance_km, state AS trigger_state, CASE WHEN is_teleport_mode THEN 'teleport' ELSE 'normal' END AS user_mode FROM t WHERE state <> 'EXITED'""")
def geofence_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes entered or inside at each scan."""
    return geofence.triggered(derived(spark, sf_dir, SCANS), derived(spark, sf_dir, FENCES), 12.0)


@query("""WITH a AS (SELECT c_custkey AS pos, 'Site ' || CAST(c_custkey // 4 AS VARCHAR) AS title FROM customer), b AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 9 = 0 THEN 'Q' || CAST(s_suppkey AS VARCHAR) ELSE 'SITE ' || CAST(s_suppkey * 5 AS VARCHAR) END AS title FROM supplier),
  k AS (SELECT pos, title FROM a QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY pos) = 1)
  SELECT 'IN-RJ-CSV-' || CASE WHEN length(CAST(pos AS VARCHAR)) < 3 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END AS node_id, title, 'A prominent cultural landmark known as ' || title || '.' AS famous_for FROM k
  UNION ALL (SELECT 'IN-RJ-WIKI-' || CASE WHEN length(CAST(pos AS VARCHAR)) < 3 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END, title, 'A prominent architectural landmark located in Rajasthan.' FROM b
    WHERE NOT regexp_matches(title, '^Q[0-9]+$') AND lower(title) NOT IN (SELECT lower(title) FROM k) QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY pos) = 1)""")
def feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds in one: the second adds the titles that the first lacks."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("Site "), F.floor(F.col("c_custkey") / 4)).alias("label"))
    s = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(s.alias("pos"), F.when(s % 9 == 0, F.concat(F.lit("Q"), s)).otherwise(F.concat(F.lit("SITE "), s * 5)).alias("label"))
    first = nodes.first_per_key(readers.map_feed(a, "csv").withColumn("_t", F.lower("title")), ["_t"], ["pos"]).drop("_t")
    return nodes.add_unseen(first, readers.map_feed(b, "wiki"), ["pos"]).select("node_id", "title", "famous_for")


#: What the nations are called in the gazetteer, by their key.
GAZETTEER_KEYS = ["RING", "BLUE", "GEAR", "OLD R", "E AN", "PLATE", "TIN", "COLD B", "ZINC", "HOT", "WIDGET", "BRASS", "NEW GI", "ROD", "L BOLT", "COPPER", "RED", "ANVIL", "GOLD", "LARGE W", "SILVER", "EAST", "WEST", "SMALL", "LEAD"]


@query(f"""WITH g AS (SELECT n_nationkey AS ord, {_LIST(GAZETTEER_KEYS)}[n_nationkey + 1] AS k, n_nationkey * 1.5 AS lat, n_nationkey * 2.5 AS lng, n_name AS city FROM nation)
  SELECT p_partkey, CAST(coalesce(lat, 26.58) AS DOUBLE) AS lat, CAST(coalesce(lng, 73.84) AS DOUBLE) AS lng, coalesce(city, 'Rajasthan (Statewide)') AS location_text, CASE WHEN city IS NULL THEN p_brand ELSE p_brand || ' Officially originates from ' || city || '.' END AS docent_details
  FROM part LEFT JOIN g ON contains(upper(p_name), k) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ord) = 1""")
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the first name of the gazetteer that a title contains."""
    k = F.col("n_nationkey")
    g = table(spark, sf_dir, "nation").select(k.alias("ord"), F.element_at(F.array(*map(F.lit, GAZETTEER_KEYS)), k + 1).alias("key"), (k * 1.5).alias("lat"), (k * 2.5).alias("lng"), F.col("n_name").alias("city"))
    return nodes.gazetteer_substring(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("docent_details")), g).drop("title")


@query("""SELECT c_custkey, coalesce(a.lat, b.lat) AS lat, coalesce(a.lng, b.lng) AS lng FROM customer
  LEFT JOIN (SELECT s_name AS name, s_suppkey + 0.5 AS lat, s_suppkey * 2.0 AS lng FROM supplier WHERE s_suppkey > 0) a ON a.name = 'Supplier#' || lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0')
  LEFT JOIN (SELECT n_name AS name, n_nationkey + 0.25 AS lat, n_nationkey * 3.0 AS lng FROM nation WHERE n_nationkey > 0) b ON b.name = 'NATION_' || CAST(c_nationkey * 2 AS VARCHAR) WHERE coalesce(a.lat, b.lat) IS NOT NULL""")
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by title, else by location; what neither finds goes."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    g = s.select(F.col("s_name").alias("name"), (F.col("s_suppkey") + 0.5).alias("lat"), (F.col("s_suppkey") * 2.0).alias("lng")).unionByName(n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 0.25).alias("lat"), (F.col("n_nationkey") * 3.0).alias("lng")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0")).alias("title"), F.concat(F.lit("NATION_"), F.col("c_nationkey") * 2).alias("location_text"))
    return nodes.geocode(c, g).select("c_custkey", "lat", "lng")


@query("""WITH w AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Point(' || CAST(c_custkey AS VARCHAR) || '.5 -' || CAST(c_nationkey AS VARCHAR) || ')' WHEN 1 THEN 'Point(1.2.3 4)' ELSE 'nowhere' END AS c FROM customer)
  SELECT c_custkey, try_cast(nullif(regexp_extract(c, 'Point\\(([-\\d\\.]+)\\s+([-\\d\\.]+)\\)', 1), '') AS DOUBLE) AS lng, try_cast(nullif(regexp_extract(c, 'Point\\(([-\\d\\.]+)\\s+([-\\d\\.]+)\\)', 2), '') AS DOUBLE) AS lat FROM w""")
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = F.when(k % 3 == 0, F.concat(F.lit("Point("), k, F.lit(".5 -"), F.col("c_nationkey"), F.lit(")"))).when(k % 3 == 1, "Point(1.2.3 4)").otherwise("nowhere")
    lng, lat = tx.wkt_point(c)
    return table(spark, sf_dir, "customer").select("c_custkey", lng.alias("lng"), lat.alias("lat"))


@query("SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS inner FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1) AS x FROM pages)")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items of saved pages."""
    return readers.elements(table(spark, sf_dir, "pages"), ["li"]).select("page_id", "pos", "inner")


@query("""WITH b AS (SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1) AS x FROM pages)),
  p AS (SELECT page_id, pos, trim(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS title FROM b)
  SELECT page_id, pos, title FROM p WHERE (length(title) > 4 AND contains(title, 'the')) OR contains(title, 'der') QUALIFY row_number() OVER (PARTITION BY title ORDER BY page_id, pos) = 1""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of saved pages that hold a word; each text once."""
    return readers.extract_blocks(table(spark, sf_dir, "pages"), ["h1"], None, ("the", "der"))


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with their list items as event cards, whose links read as festivals."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", "<li>", '<li class="item">'), "</a></li>", " Festival - 2027 on</a><span>known far and wide</span></li>").alias("html"))


@query()
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event cards of pages."""
    return readers.extract_cards(card_pages(spark, sf_dir))


@query(f"""WITH {_BASE} SELECT id AS node_id, title, coalesce(nullif(category, ''), 'TANGIBLE_HERITAGE') AS category, {_GROUP} AS heritage_group, nullif(era, '') AS era, {_PLACE} AS district, {_GI} AS gi_type, lat AS latitude, lng AS longitude,
  nullif(famous_for, '') AS famous_for, nullif(docent_details, '') AS docent_details, nullif(nearby_culture, '') AS nearby_culture, coalesce(nullif(docent_details, ''), nullif(famous_for, ''), title || ' is a documented cultural node in Rajasthan.') AS content,
  coalesce(nullif(trust, ''), 'verified') AS trust_status, nullif(trim(photo), '') AS photo_url FROM n WHERE pos % 50 <> 7""")
def normalized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.normalize_nodes(raw_nodes(spark, sf_dir)).drop("content_source", "merged_into")


@query("""SELECT coalesce(o.o_orderkey, u.o_orderkey) AS o_orderkey, CASE WHEN u.o_orderkey IS NULL THEN o.o_totalprice WHEN o.o_orderstatus = 'F' THEN o.o_totalprice ELSE u.o_totalprice END AS o_totalprice, o.o_orderstatus
  FROM (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) u ON o.o_orderkey = u.o_orderkey""")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inserted or overwritten; finished ones keep their price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return sinks.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), ["o_orderkey"], {"o_totalprice": F.col("o_orderstatus") == "F"})


@query(f"""WITH {_BASE} SELECT id AS node_id, CASE WHEN pos % 4 = 1 THEN 'rewritten' ELSE 'seed' END AS content, CASE WHEN pos % 4 = 1 THEN 'ai_enriched' ELSE 'original' END AS content_source, CASE WHEN pos % 6 = 2 THEN 'merged_duplicate' ELSE 'verified' END AS trust_status, CASE WHEN pos % 6 = 2 THEN 'N0' END AS merged_into FROM n""")
def seed_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes seeded again over later work."""
    p = F.col("pos")
    n = derived(spark, sf_dir, NODES)
    old = n.where("pos % 2 = 0 or pos % 4 = 1").select(F.col("id").alias("node_id"), F.when(p % 4 == 1, "rewritten").otherwise("old").alias("content"), F.when(p % 4 == 1, "ai_enriched").otherwise("original").alias("content_source"), F.when(p % 6 == 2, "merged_duplicate").otherwise("disputed").alias("trust_status"), F.when(p % 6 == 2, "N0").alias("merged_into"))
    return sinks.seed_merge(old, n.select(F.col("id").alias("node_id"), F.lit("seed").alias("content"), F.lit("original").alias("content_source"), F.lit("verified").alias("trust_status")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns updated by key; a null in the patch changes nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    patch = c.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return sinks.update_by_key(c, patch, "c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 0, 1.0 FROM orders WHERE o_orderkey % 5 = 0")
def replace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of some keys dropped and written anew."""
    lines, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    return sinks.replace_for_keys(lines, o.select(F.col("o_orderkey").alias("l_orderkey")), o.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(1.0).alias("l_quantity")))


@query("SELECT p_partkey, p_type FROM part WHERE NOT contains(p_type, 'ECO') UNION ALL SELECT s_suppkey, 'NEW' FROM supplier")
def replace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of parts dropped, and rows of another feed added."""
    return sinks.replace_slice(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.contains("p_type", F.lit("ECO")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit("NEW").alias("p_type")))


@query("""WITH e AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS s, 'S' || CAST(o_orderkey % 130 AS VARCHAR) AS t FROM orders), n AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS i FROM customer UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier)
  SELECT 'edges' AS "table", 'unique(source_id,target_id)' AS rule, s || '|' || t AS key FROM e GROUP BY s, t HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'edges', 'references(target_id)', t FROM e WHERE t NOT IN (SELECT i FROM n)
  UNION ALL SELECT DISTINCT 'edges', 'references(source_id)', s FROM e WHERE s NOT IN (SELECT i FROM n)
  UNION ALL SELECT DISTINCT 'clusters', 'references(parent_id)', CAST(n_regionkey + 1 AS VARCHAR) FROM nation WHERE n_regionkey + 1 NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'nodes', 'not_null(title)', 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 0""")
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in a graph of customers and suppliers joined by orders."""
    c, s, o, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "nation"))
    none = F.lit(None).cast("string")
    own = c.select(F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.col("c_name").alias("title"), none.alias("merged_into")).unionByName(s.select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_name")).alias("title"), none.alias("merged_into")))
    clusters = n.select(F.col("n_nationkey").cast("string").alias("cluster_id"), (F.col("n_regionkey") + 1).cast("string").alias("parent_id"))
    members = c.select(F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.col("c_nationkey").cast("string").alias("cluster_id"))
    edges = o.select(F.concat(F.lit("C"), "o_custkey").alias("source_id"), F.concat(F.lit("S"), F.col("o_orderkey") % 130).alias("target_id"))
    return quality.audit_constraints(own, clusters, members, edges)


_SUB = "s AS (" + duck(SUBMISSIONS) + ")"


@query(f"""WITH {_SUB} SELECT submission_id, CASE WHEN trim(title) = '' OR trim(coalesce(description, '')) = '' THEN 'title and description are required' WHEN photo_type = 'text/plain' THEN 'unsupported photo type' WHEN photo_bytes > 8388608 THEN 'photo too large' END AS reason,
  CASE WHEN reason IS NULL THEN trim(title) END AS title, CASE WHEN reason IS NULL THEN nullif(trim(contributor_name), '') END AS contributor_name FROM s""")
def validate_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejects = review.validate_submissions(derived(spark, sf_dir, SUBMISSIONS))
    none = F.lit(None).cast("string")
    return valid.select("submission_id", none.alias("reason"), "title", "contributor_name").unionByName(rejects.select("submission_id", "reason", none.alias("title"), none.alias("contributor_name")))


@query(f"WITH {_SUB} SELECT submission_id, created_at, 'https://files/' || photo_path AS photo_url FROM s WHERE status = 'pending'")
def list_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.list_submissions(derived(spark, sf_dir, SUBMISSIONS), "pending", "https://files/").select("submission_id", "created_at", "photo_url")


@query(f"WITH {_SUB} SELECT submission_id, CASE WHEN CAST(submission_id AS BIGINT) % 6 = 1 THEN 'TANGIBLE_FORT' ELSE category END AS category FROM s")
def patch_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, SUBMISSIONS).select("submission_id", "category", F.lit(None).cast("array<string>").alias("tags"))
    k = F.col("submission_id").cast("long")
    patches = s.where(k % 3 == 1).select("submission_id", F.when(k % 6 == 1, "TANGIBLE_FORT").alias("category"), "tags")
    return review.patch_submissions(s, patches)[0].select("submission_id", "category")


@query(f"WITH {_SUB} SELECT submission_id, CASE WHEN CAST(submission_id AS BIGINT) % 4 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN CAST(submission_id AS BIGINT) % 4 = 0 THEN 'admin' END AS reviewed_by FROM s")
def reject_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, SUBMISSIONS).select("submission_id", "status", F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    return review.reject(s, s.where(F.col("submission_id").cast("long") % 4 == 0), "admin").drop("reviewed_at")


@query(f"WITH {_SUB} SELECT CAST(CAST(s.submission_id AS BIGINT) * 2 AS VARCHAR) AS submission_id, CASE WHEN t.status IS NULL THEN 'missing' WHEN t.status <> 'pending' THEN 'conflict' ELSE 'ok' END AS outcome FROM s LEFT JOIN s t ON CAST(t.submission_id AS BIGINT) = CAST(s.submission_id AS BIGINT) * 2")
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, SUBMISSIONS)
    return review.approval_gate(s, s.select((F.col("submission_id").cast("long") * 2).cast("string").alias("submission_id")))


@query(f"""WITH {_SUB} SELECT submission_id, 'community-' || substr({_SLUG.format('title')}, 1, 40) || '-' || substr(sha256(submission_id), 1, 6) AS node_id, CASE WHEN coalesce(category, '') = '' THEN 'TANGIBLE_HERITAGE' ELSE category END AS category, length(trim(description || ' ' || description)) < 40 AS is_thin FROM s WHERE status = 'pending' AND description IS NOT NULL""")
def derive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending submissions as nodes."""
    return review.derive_nodes(derived(spark, sf_dir, SUBMISSIONS).where("status = 'pending' and description is not null").withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)})).select("submission_id", "node_id", "category", "is_thin")


_PHOTO = "CASE " + " ".join(f"WHEN contains(upper(coalesce(category, '')), '{w}') THEN '{nodes.PHOTOS[k]}'" for w, k in nodes.PHOTO_WORDS) + f" ELSE '{nodes.PHOTOS['DEFAULT']}' END"


@query(f"WITH {_BASE} SELECT id, CASE WHEN coalesce(photo, '') = '' THEN {_PHOTO} ELSE photo END AS filled, CASE WHEN regexp_matches(title, 'Fort|Temple|Palace') THEN '{nodes.FILE_PATH}' || replace(replace(replace(replace(title, ' ', '%20'), '(', '%28'), ')', '%29'), ',', '%2C') || '.jpg' ELSE photo END AS rebuilt FROM n")
def node_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos filled in by category, and rebuilt from titles."""
    n = derived(spark, sf_dir, NODES).withColumnRenamed("photo", "photo_url")
    filled = nodes.fill_photo(n).select("id", F.col("photo_url").alias("filled"))
    return filled.join(nodes.rebuild_photo_url(n).select("id", F.col("photo_url").alias("rebuilt")), "id")


@query(f"WITH {_BASE} SELECT id, CASE WHEN trim(coalesce(photo, '')) = '' AND pos % 3 = 0 THEN 'http://thumb/' || CAST(pos AS VARCHAR) ELSE photo END AS photo_url, CASE WHEN trim(coalesce(photo, '')) = '' AND pos % 3 = 0 THEN 'Archive' END AS attribution FROM n")
def photo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived(spark, sf_dir, NODES).select("id", "pos", F.concat("title", F.lit(" "), "pos").alias("title"), F.col("photo").alias("photo_url"))
    return nodes.join_photo_lookup(n, n.where("pos % 3 = 0").select("title", F.concat(F.lit("http://thumb/"), "pos").alias("thumb")), "Archive").select("id", "photo_url", "attribution")


@query(f"WITH {_FACTS} SELECT id, 'Title: ' || title || chr(10) || 'Category: ' || {_PRETTY} || CASE WHEN coalesce(era, '') <> '' THEN chr(10) || 'Era: ' || era ELSE '' END || CASE WHEN coalesce(place, '') <> '' THEN chr(10) || 'District/region: ' || place ELSE '' END || CASE WHEN coalesce(gi_fact, '') <> '' THEN chr(10) || 'GI type: ' || gi_fact ELSE '' END || CASE WHEN coalesce(nearby_culture, '') <> '' THEN chr(10) || 'Nearby culture note: ' || nearby_culture ELSE '' END AS prompt FROM f WHERE {_BOILER}")
def enrich_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the nodes whose texts are boilerplate."""
    n = flat_nodes(spark, sf_dir).withColumns({"district": F.col("place"), "gi_type": F.col("gi_fact"), "merged_into": F.lit(None), "content_source": F.lit("original")})
    return nodes.enrich_candidates(n).select("id", nodes.enrich_prompt().alias("prompt"))


@query(f"""WITH {_FACTS} SELECT id, '# ' || title || chr(10) || chr(10) || '**Category:** ' || {_PRETTY} || '  ' || CASE WHEN coalesce(era, '') <> '' THEN chr(10) || '**Era:** ' || era || '  ' ELSE '' END || CASE WHEN place IS NOT NULL THEN chr(10) || '**Region:** ' || array_to_string(list_transform(string_split(place, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') || '  ' ELSE '' END
  || chr(10) || '**Trust status:** ' || coalesce(nullif(trust, ''), 'verified') || '  ' || chr(10) || CASE WHEN coalesce(famous_for, '') <> '' THEN chr(10) || famous_for ELSE '' END || CASE WHEN coalesce(docent_details, '') <> '' AND docent_details IS DISTINCT FROM famous_for THEN chr(10) || chr(10) || docent_details ELSE '' END
  || CASE WHEN coalesce(nearby_culture, '') <> '' THEN chr(10) || chr(10) || '**Nearby culture:** ' || nearby_culture ELSE '' END AS content FROM f""")
def node_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_nodes(spark, sf_dir).select("id", nodes.content_document().alias("content"))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs in batches, and a reply to each batch as a judge would give it."""
    pairs = links.number_batches(vectors.knn_candidates(_vectors(spark, sf_dir)[1]))
    even = (F.col("source_id") + F.col("target_id")) % 2 == 0
    verdict = F.struct(F.col("index"), even.alias("connect"), F.when(F.col("source_id") % 3 == 0, "guess").otherwise("potential").alias("tier"), F.when(F.col("target_id") % 5 == 0, " ").otherwise(" near in meaning ").alias("rationale"))
    raw = F.to_json(F.struct(F.array_sort(F.collect_list(verdict)).alias("results")))
    return pairs, pairs.groupBy("batch").agg(raw.alias("raw"))


@query(f"""WITH k AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.35), c AS (SELECT least(x, y) AS source_id, greatest(x, y) AS target_id, max(s) AS score FROM k WHERE r <= 6 GROUP BY ALL)
  SELECT source_id, target_id, 'potential' AS tier, round(score, 4) AS score, 'near in meaning' AS rationale FROM c WHERE (source_id + target_id) % 2 = 0 AND source_id % 3 <> 0 AND target_id % 5 <> 0""")
def verdict_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from judged candidate pairs; malformed verdicts form none."""
    pairs, replies = _judged(spark, sf_dir)
    from ..sources.schemas import LINK_VERDICTS

    return links.apply_link_verdicts(pairs, links.parse_verdicts(replies, LINK_VERDICTS))[0].drop("formed_by")


_KNN = f"""k AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.35),
  c AS (SELECT least(x, y) AS source_id, greatest(x, y) AS target_id, max(s) AS score FROM k WHERE r <= 6 GROUP BY ALL)"""


@query(f"""WITH {_KNN}, m AS (SELECT *, row_number() OVER (ORDER BY source_id, target_id) - 1 AS nth FROM c)
  SELECT '0-' || CAST(nth // 5 AS VARCHAR) AS batch, string_agg('Pair ' || CAST(nth % 5 AS VARCHAR) || ':' || chr(10) || 'Node A: ' || CAST(source_id AS VARCHAR) || chr(10) || 'Node B: ' || CAST(target_id AS VARCHAR) || chr(10) || 'Embedding cosine similarity: ' || printf('%.3f', score), chr(10) || chr(10) ORDER BY nth) AS prompt FROM m GROUP BY nth // 5""")
def candidate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of up to five candidate pairs each."""
    pairs = links.number_batches(vectors.knn_candidates(_vectors(spark, sf_dir)[1]))
    return links.batch_prompts(pairs, F.concat(F.lit("Node A: "), "source_id", F.lit("\nNode B: "), "target_id", F.format_string("\nEmbedding cosine similarity: %.3f", "score")))


@query(f"WITH {_FACTS} SELECT a.pos AS a, b.pos AS b, coalesce(nullif(concat_ws('; ', CASE WHEN a.place <> '' AND a.place = b.place THEN 'same district (' || a.place || ')' END, CASE WHEN a.era <> '' AND a.era = b.era THEN 'same specific era (' || a.era || ')' END, CASE WHEN a.gi_fact <> '' AND a.gi_fact = b.gi_fact THEN 'same GI type (' || a.gi_fact || ')' END, CASE WHEN a.heritage_group IS NOT DISTINCT FROM b.heritage_group THEN 'same heritage group' END), ''), 'no structural overlap detected') AS hints FROM f a JOIN f b ON a.pos < b.pos AND {_KM.format('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 15")
def pair_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neighbours share."""
    n = flat_nodes(spark, sf_dir)
    told = settled(n.select(F.struct("pos", F.col("place").alias("district"), "era", F.col("gi_fact").alias("gi_type"), "heritage_group").alias("id"), "lat", "lng"))  # facts go with the points, so no pair is shuffled for them
    pairs = links.radius_pairs(told, 15, id_col="id").where("a.pos < b.pos")
    return pairs.select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), nodes.hints("a.", "b.").alias("hints"))


@query(f"WITH {_BASE} SELECT id, title FROM n WHERE contains(lower(title), 'palace') ORDER BY pos LIMIT 1")
def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.find_node(derived(spark, sf_dir, NODES), "Palace").select("id", "title")


@query()
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed bag-of-words vectors of whole documents."""
    return vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put together in order."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


@query("SELECT event_type, count(*) AS events, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 3) AS k FROM events GROUP BY event_type")
def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads by a fixed schema; malformed ones count as null."""
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k double")["k"].alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("k"), 3).alias("k"))


def promotion_verdicts(new: DataFrame, there: DataFrame, alike: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts on all candidate pairs of a promotion, as a judge would give them, by the
    pair's checksum: (same_subject, link_verdicts), some of the latter malformed. alike:
    vectors.alike() of both, where the caller has them."""
    asked, known = alike or (vectors.alike(new, "node_id"), vectors.alike(there, "node_id"))

    def pairs(k: int | None, least: float) -> DataFrame:
        found = vectors.best_alike(asked, known, k, least).select(F.col("query_id").alias("node_id"), F.col("node_id").alias("other_id"))
        return found.withColumn("sum", F.crc32(F.concat_ws("|", "node_id", "other_id").cast("binary")))

    c = F.col("sum")
    same = pairs(None, review.DUPLICATE_FROM).where(c % 2 == 0).drop("sum")
    said = pairs(review.NEIGHBOURS, review.LEAST_COSINE).select("node_id", "other_id", (c % 2 == 0).alias("connect"), F.when(c % 3 == 0, "guess").otherwise("potential").alias("tier"), F.when(c % 5 == 0, " ").otherwise(" near in meaning ").alias("rationale"))
    return written(same)[0], written(said)[0]


@query()
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending submissions promoted into the graph of document vectors."""
    s = spread(derived(spark, sf_dir, SUBMISSIONS)).where("status = 'pending' and description is not null and trim(title) <> ''").withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)})
    new = vectors.embed(review.derive_nodes(s), "content")
    there = vectors.embed(flat_nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "title", F.col("docent_details").alias("content")), "content").select("node_id", "title", "embedding")
    alike = vectors.alike(new, "node_id"), vectors.alike(there, "node_id")
    return review.promote(new, there, *promotion_verdicts(new, there, alike), vectors=alike)["outcome"]
