"""Registered queries of feeds, payloads, pages and submissions, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import nodes, review, vectors
from ..operators.staging import spread
from ..sources import readers, sinks
from .queries import _BASE, _SUB
from .registry import query
from .tables import NODES, SUBMISSIONS, derived, table

_PAD = "CASE WHEN length(CAST(pos AS VARCHAR)) < {0} THEN lpad(CAST(pos AS VARCHAR), {0}, '0') ELSE CAST(pos AS VARCHAR) END"
_FEED = "f AS (SELECT s_suppkey AS pos, 'Gate ' || CAST(s_suppkey AS VARCHAR) AS label, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Kind ' || CAST(s_nationkey AS VARCHAR) END AS kind, 'Kota' AS second, CASE WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE s_suppkey * 0.5 END AS lat, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey * 0.25 END AS lng FROM supplier)"


@query(f"""WITH {_FEED}
  SELECT 'asi' AS feed, 'IN-RJ-ASI-' || {_PAD.format(3)} AS node_id, label AS title, 'TANGIBLE_ASI_PROTECTED' AS category, concat_ws(', ', kind, second) AS location_text, 'Government Protected Antiquity' AS era, 'A centrally protected monument located in the Kota district.' AS famous_for,
    'Regional heritage of Kota.' AS nearby_culture, 'Officially gazetted by the Archaeological Survey of India (ASI) Jaipur Circle. Locality: ' || coalesce(kind, '') || '.' AS docent_details, 'government_verified' AS trust_status, CASE WHEN lng IS NOT NULL THEN lat END AS lat FROM f
  UNION ALL SELECT 'gi', 'IN-RJ-GI-' || substr(regexp_replace(upper(label), '[^A-Z0-9]', '', 'g'), 1, 10) || '-' || {_PAD.format(3)}, label, 'GASTRONOMY_OR_CRAFT_GI_TAG', 'Rajasthan', 'Traditional Heritage', 'A legally protected Geographical Indication (GI) from Rajasthan.',
    'Deep regional heritage.', 'Registered under the Geographical Indications of Goods Act. Type: ' || upper(coalesce(kind, '')) || '.', 'government_verified', CASE WHEN lng IS NOT NULL THEN lat END FROM f
  UNION ALL SELECT 'festival', 'IN-RJ-LIVE-FEST-' || {_PAD.format(3)}, label, 'INTANGIBLE_FESTIVAL', 'Rajasthan', 'Annual Cultural Event', 'A cultural event officially listed on the Rajasthan Tourism portal.', NULL, 'Live-scraped from tourism.rajasthan.gov.in.', 'government_verified', CASE WHEN lng IS NOT NULL THEN lat END FROM f
  UNION ALL SELECT 'osm', 'IN-RJ-OSM-' || {_PAD.format(4)}, label, 'TANGIBLE_' || upper(coalesce(kind, '')), NULL, 'Local Heritage', 'A local ' || lower(coalesce(kind, '')) || ' documented by open-source ground mapping.', 'Deep regional heritage.',
    'This ' || lower(coalesce(kind, '')) || ' represents the grassroots cultural infrastructure of Rajasthan.', 'community_verified', lat FROM f WHERE lat <> 0 AND lng <> 0""")
def feed_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of four feeds, in each feed's wording."""
    s = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select(s.alias("pos"), F.concat(F.lit("Gate "), s).alias("label"), F.when(s % 4 != 0, F.concat(F.lit("Kind "), F.col("s_nationkey"))).alias("kind"), F.lit("Kota").alias("second"), F.when(s % 7 == 0, 0.0).otherwise(s * 0.5).alias("lat"), F.when(s % 9 != 0, s * 0.25).alias("lng"))
    rows = [readers.map_feed(f, name).select(F.lit(name).alias("feed"), "node_id", "title", "category", "location_text", "era", "famous_for", "nearby_culture", "docent_details", "trust_status", F.col("coordinates.lat").alias("lat")) for name in ("asi", "gi", "festival", "osm")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""SELECT c_nationkey AS page, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown Site' ELSE trim(' ' || c_name) END AS label, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Point(1 ' || CAST(c_custkey AS VARCHAR) || ')' END AS coord FROM customer""")
def query_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as query payloads, a payload a nation, and flat again."""
    k = F.col("c_custkey")
    binding = F.struct(F.struct(F.when(k % 5 != 0, F.concat(F.lit(" "), "c_name")).alias("value")).alias("itemLabel"), F.struct(F.when(k % 3 != 0, F.concat(F.lit("Point(1 "), k, F.lit(")"))).alias("value")).alias("coord"), F.struct(F.lit(None).cast("string").alias("value")).alias("image"))
    sorted_rows = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), binding.alias("b")))), lambda x: x["b"])
    payloads = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.struct(sorted_rows.alias("bindings")).alias("results"))
    return readers.flatten_bindings(payloads, "page").select("page", "pos", "label", "coord")


@query("""SELECT c_nationkey AS page, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_name AS label, CASE WHEN c_custkey % 4 = 0 THEN 'heritage site' ELSE 'fort' END AS historic,
  CASE WHEN c_custkey % 3 = 0 THEN 5.5 ELSE c_custkey * 1.0 END AS lat, CASE WHEN c_custkey % 3 = 0 THEN 6.5 ELSE c_custkey * 2.0 END AS lng FROM customer WHERE c_custkey > 0""")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as map payloads, a payload a nation, and flat again; a third have a centre only."""
    k = F.col("c_custkey")
    own = lambda by: F.when(k % 3 != 0, k * by).otherwise(F.lit(0.0))
    tags = F.map_filter(F.create_map(F.lit("name"), F.concat(F.lit(" "), "c_name"), F.lit("historic"), F.when(k % 4 != 0, "fort")), lambda _, v: v.isNotNull())
    element = F.struct(own(1.0).alias("lat"), own(2.0).alias("lon"), F.struct(F.lit(5.5).alias("lat"), F.lit(6.5).alias("lon")).alias("center"), tags.alias("tags"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.to_json(element).alias("e")))), lambda x: x["e"])
    kind = "lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>"
    payloads = table(spark, sf_dir, "customer").where(k > 0).groupBy(F.col("c_nationkey").alias("page")).agg(F.transform(rows, lambda x: F.from_json(x, kind)).alias("elements"))
    return readers.flatten_elements(payloads, "page")


_LINES = "r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_partkey, CAST(l_suppkey AS VARCHAR) AS s, l_returnflag FROM lineitem)"


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: its lines as a table of the class wikitable."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")))
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    line = lambda x: F.concat(F.lit("<tr>"), cell(F.when(x["l_partkey"] % 5 == 0, " ").otherwise(F.concat(F.lit("Part &amp; "), x["l_partkey"]))), cell(x["l_suppkey"]), cell(F.concat(F.lit("<b>n"), x["l_suppkey"], F.lit("</b>"))), cell(x["l_returnflag"]), F.lit("</tr>"))
    html = F.concat(F.lit('<table class="x wikitable"><tr><th> Name </th><th>Supplier</th><th>No</th><th>Flag</th></tr>'), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")  # pages are parsed where they are made, by as many tasks as a shuffle has
    return lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(html.alias("html"))


@query(f"WITH {_LINES} SELECT l_orderkey AS page_id, CAST(n - 1 AS INTEGER) AS pos, 'Part & ' || CAST(l_partkey AS VARCHAR) AS name, s AS supplier FROM r WHERE l_partkey % 5 <> 0")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in pages, by their headers; rows without a name go."""
    return readers.extract_table_rows(_order_pages(spark, sf_dir), "Name").select("page_id", "pos", F.col("values")["Name"].alias("name"), F.col("values")["Supplier"].alias("supplier"))


@query(f"WITH {_LINES} SELECT l_orderkey AS page_id, CAST(n - 1 AS INTEGER) AS pos, 'n' || s AS name, l_returnflag AS kind FROM r WHERE contains(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'Part & ' || CAST(l_partkey AS VARCHAR) END || ' | ' || s || ' | n' || s || ' | ' || l_returnflag, '12')")
def html_filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables of a class that name a term, here '12'."""
    return readers.extract_filtered_rows(_order_pages(spark, sf_dir), "12").select("page_id", "pos", "name", "kind")


_TITLE = "CASE c_custkey % 6 WHEN 0 THEN 'Desert Festival - 2027 on ' || c_name WHEN 1 THEN 'Camel Fair ' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'FESTIVALS of Rajasthan Festival' WHEN 3 THEN 'A plain name' WHEN 4 THEN 'FESTIVALS Fair' ELSE 'FESTIVALS one two three four five six Fair' END"


@query(f"WITH t AS (SELECT c_custkey, {_TITLE} AS raw FROM customer), c AS (SELECT *, trim(replace(trim(regexp_replace(raw, '[-–—]\\s*\\d{{4}}.*', '')), 'FESTIVALS', '')) AS clean FROM t) SELECT c_custkey, CASE WHEN length(raw) <= 50 AND NOT (contains(raw, 'FESTIVALS') AND len(string_split_regex(raw, '\\s+')) > 6) AND regexp_matches(raw, 'Festival|Fair|Utsav') AND length(clean) >= 3 THEN clean END AS title FROM c")
def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of events, cleaned; what reads as none is null."""
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("Desert Festival - 2027 on "), "c_name")).when(k % 6 == 1, F.concat(F.lit("Camel Fair "), k)).when(k % 6 == 2, "FESTIVALS of Rajasthan Festival").when(k % 6 == 3, "A plain name").when(k % 6 == 4, "FESTIVALS Fair").otherwise("FESTIVALS one two three four five six Fair")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.event_title(raw).alias("title"))


@query(f"WITH {_BASE} SELECT id, 'IN-RJ-' || substr(regexp_replace(upper(coalesce(title, '')), '[^A-Z0-9]', '', 'g'), 1, 10) || '-' || {_PAD.format(4)} AS code FROM n")
def code_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NODES).select("id", tx.code_id("IN-RJ-", "title", F.col("pos"), 4).alias("code"))


@query(f"WITH {_SUB}, t AS (SELECT submission_id, [category, status, contributor_note] AS tags, CAST(submission_id AS BIGINT) AS k FROM s), u AS (SELECT submission_id, k, list_filter(tags, lambda x, i: k % 5 <> 1 OR i - 1 <> k % 4) AS l, tags, CASE k % 5 WHEN 1 THEN NULL WHEN 2 THEN ' new ' WHEN 3 THEN '  ' WHEN 4 THEN 'pending' END AS new FROM t) SELECT submission_id, array_to_string(list_transform(CASE WHEN k % 5 = 0 THEN tags WHEN coalesce(trim(new), '') <> '' AND NOT list_contains(l, trim(new)) THEN list_append(l, trim(new)) ELSE l END, lambda x: coalesce(x, '-')), ',') AS tags FROM u")
def tag_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags dropped by index and added at the end."""
    s = derived(spark, sf_dir, SUBMISSIONS).select("submission_id", F.array("category", "status", "contributor_note").alias("tags"))
    k = F.col("submission_id").cast("long")
    edits = s.where(k % 5 != 0).select("submission_id", F.when(k % 5 == 1, k % 4).cast("int").alias("remove_at"), F.when(k % 5 == 2, " new ").when(k % 5 == 3, "  ").when(k % 5 == 4, "pending").alias("add"))
    return review.edit_tags(s, edits).select("submission_id", F.array_join("tags", ",", "-").alias("tags"))


@query(f"WITH {_SUB} SELECT CASE WHEN CAST(submission_id AS BIGINT) % 2 = 0 THEN 'pending' ELSE status END AS status, count(*) AS n, count(*) AS ids, count(*) AS times FROM s GROUP BY 1")
def submission_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with defaults where they lack an id, a status or a time."""
    k = F.col("submission_id").cast("long")
    s = derived(spark, sf_dir, SUBMISSIONS).select(F.when(k % 2 == 1, F.col("status")).alias("status"), F.when(k % 3 != 0, F.col("submission_id")).alias("submission_id"))
    made = sinks.insert_with_defaults(s)
    return made.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("submission_id").alias("ids"), F.count("created_at").alias("times"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS ok, CASE WHEN c_custkey % 4 <> 0 THEN 'said: ' || c_name END AS raw, CASE WHEN c_custkey % 4 = 0 THEN 'ValueError: no answer' END AS error FROM customer")
def judged_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a function to prompts; a call that fails leaves its error and no reply."""

    def ask(prompt: str) -> str:
        if prompt.startswith("bad"):
            raise ValueError("no answer")
        return f"said: {prompt}"

    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("bad "), "c_name")).otherwise(F.col("c_name")).alias("prompt"))
    return vectors.judge(asked, "prompt", ask).drop("prompt")


@query(f"WITH {_BASE} SELECT DISTINCT category FROM n WHERE category IN ('TANGIBLE_FORT', 'TANGIBLE_ASI_PROTECTED', 'TANGIBLE_STEPWELL', 'INTANGIBLE_MUSIC', 'INTANGIBLE_FESTIVAL', 'GASTRONOMY_OR_CRAFT_GI_TAG', 'TANGIBLE_TOMB')")
def used_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories with a rule that nodes have, sorted."""
    return review.categories(spark).join(derived(spark, sf_dir, NODES).select("category").distinct(), "category", "left_semi").orderBy("category")


@query(f"WITH {_BASE} SELECT id, coalesce(photo, '') AS photo FROM n WHERE trim(coalesce(photo, '')) = '' OR starts_with(coalesce(photo, ''), ' http://photos/1')")
def photo_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a photo, or with one of a given beginning."""
    n = derived(spark, sf_dir, NODES).select("id", F.col("photo").alias("photo_url"))
    return nodes.needs_photo(n, " http://photos/1").select("id", F.coalesce("photo_url", F.lit("")).alias("photo"))
