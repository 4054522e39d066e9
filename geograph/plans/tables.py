"""Tables of the graph derived from the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Customers and parts as flat nodes on a map.
NODES = """
SELECT c_custkey AS pos, 'N' || lpad(CAST(c_custkey AS STRING), 9, '0') AS id,
  p_name || CASE c_custkey % 5 WHEN 0 THEN ' Fort ' WHEN 1 THEN ' Temple (old) ' WHEN 2 THEN ' Blue Pottery ' WHEN 3 THEN ' Jaipur Palace ' ELSE ' Marble Well, ' END || CAST(c_custkey % 7 AS STRING) AS title,
  CASE p_size % 10 WHEN 0 THEN 'TANGIBLE_FORT' WHEN 1 THEN 'TANGIBLE_ASI_PROTECTED' WHEN 2 THEN 'TANGIBLE_STEPWELL' WHEN 3 THEN 'INTANGIBLE_MUSIC' WHEN 4 THEN 'INTANGIBLE_FESTIVAL'
    WHEN 5 THEN 'GASTRONOMY_OR_CRAFT_GI_TAG' WHEN 6 THEN 'TANGIBLE_TOMB' WHEN 7 THEN '' WHEN 8 THEN 'OTHER_KIND' ELSE NULL END AS category,
  CASE c_custkey % 6 WHEN 0 THEN 'Local Heritage' WHEN 1 THEN 'an ancient time ' || CAST(p_partkey % 90 AS STRING) WHEN 2 THEN 'about the ' || CAST(p_size % 30 AS STRING) || 'th century' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE ' Historical Database ' END AS era,
  CASE c_custkey % 3 WHEN 0 THEN 'A centrally protected monument located in the Dist ' || chr(CAST(97 + c_nationkey AS INT)) || ' district.'
    WHEN 1 THEN 'A local fort documented by open-source ground mapping.' ELSE NULL END AS famous_for,
  CASE WHEN c_custkey % 10 = 3 THEN 'Registered under the Geographical Indications of Goods Act. Type: KIND ' || chr(CAST(65 + p_size % 20 AS INT)) || '.'
    WHEN c_custkey % 10 = 4 THEN 'Known for long, and for good reasons too. Officially originates from Greater Kota Area.'
    WHEN c_custkey % 10 = 5 THEN 'Officially originates from Plain Place.' WHEN c_custkey % 10 = 6 THEN '' ELSE 'Number ' || CAST(c_custkey AS STRING) || ' stands on its own ground by the road.' END AS docent_details,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS nearby_culture,
  CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 8 = 1 THEN NULL ELSE ' http://photos/' || CAST(c_custkey AS STRING) || ' ' END AS photo,
  CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 9 = 1 THEN 'disputed' ELSE NULL END AS trust,
  23.35 + CAST((c_custkey * 37) % 658 AS DOUBLE) / 100 AS lat, 70.35 + CAST((c_custkey * 53) % 755 AS DOUBLE) / 100 AS lng
FROM {customer} JOIN {part} ON p_partkey = c_custkey
"""

#: Events as scans; sign-ups reset their session.
SCANS = """
SELECT 'S' || CAST(user_id AS STRING) AS session_id, event_id, ts,
  23.35 + CAST((event_id * 41) % 658 AS DOUBLE) / 100 AS latitude, 70.35 + CAST((event_id * 59) % 755 AS DOUBLE) / 100 AS longitude,
  CAST(20 + event_id % 3 AS DOUBLE) AS radius_km, event_id % 11 = 0 AS is_teleport_mode, event_type = 'signup' AS is_reset
FROM {events}
"""

#: The fences that scans are held against.
FENCES = """
SELECT 'N' || CAST(s_suppkey AS STRING) AS node_id, 23.35 + CAST((s_suppkey * 137) % 658 AS DOUBLE) / 100 AS lat, 70.35 + CAST((s_suppkey * 253) % 755 AS DOUBLE) / 100 AS lng
FROM {supplier}
"""

#: Orders as submissions.
SUBMISSIONS = """
SELECT CAST(o_orderkey AS STRING) AS submission_id, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE ' Order of ' || o_orderpriority || ' ' END AS title,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'Seen on the way, number ' || CAST(o_orderkey AS STRING) END AS description,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'TANGIBLE_' || substr(o_orderpriority, 3) END AS category,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' ELSE 'text/plain' END AS photo_type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice * 50 AS BIGINT) END AS photo_bytes,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) || '.png' END AS photo_path,
  CASE WHEN o_orderkey % 7 = 0 THEN '   ' ELSE ' C' || CAST(o_custkey AS STRING) END AS contributor_name, o_orderpriority AS contributor_note,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderdate AS created_at
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the queries above over the tables of sf_dir."""
    import string

    names = {n for _, n, _, _ in string.Formatter().parse(sql) if n}
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """The same query for DuckDB, whose views have the tables' names."""
    import string

    return sql.format(**{n: n for _, n, _, _ in string.Formatter().parse(sql) if n})
