import numpy as np
import pytest
from pyspark.sql import functions as F

from geograph.operators import vector_index, vectors


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"node_id long, embedding array<{kind}>")


def queries_of(nodes, every=1):
    return nodes.where(F.col("node_id") % every == 0).select(F.col("node_id").alias("query_id"), "embedding")


def clusters(n=600, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, 16))
    rows = at[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, 16))
    rows[: n // 3] = at[0] + 0.05 * rng.normal(size=(n // 3, 16))  # one cell holds a third of all rows
    rows[10:30] = rows[10]  # equal rows
    return [(i, r) for i, r in enumerate(rows)]


ODD = [(5000, [0.0] * 16), (5001, [1e-12] + [0.0] * 15), (5002, [3.0]), (5003, [1.0] * 24), (5004, None), (5005, []), (5006, [float("nan")] * 16), (5007, [None] * 16), (5008, [1e30] * 16), (None, [1.0] * 16)]


def test_exact_search_is_the_blockwise_one(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 40)  # large cells in parts
    monkeypatch.setattr(vector_index, "VISITS", 50)  # visits of a shard dealt to several tasks
    nodes = table(spark, clusters() + ODD).repartition(5)
    index = vector_index.build(nodes)
    asked = queries_of(nodes, 3)
    for probes in (0, 1, len(index)):
        found = vector_index.search(index, asked, 7, probes, exact=True, skip_same=True).collect()
        expect = vectors.best_matches(asked, nodes.where("node_id is not null"), 7, skip_same=True).collect()
        key = lambda r: (r.query_id, r.node_id, r["rank"], round(r.similarity, 9))
        assert sorted(map(key, found)) == sorted(map(key, expect))


def test_cells_that_hold_nothing_near_are_not_read(spark):
    nodes = table(spark, clusters())
    index = vector_index.build(nodes, vector_index.fit_pivots(nodes, 24))
    asked = index.rows.select(F.col("node_id").alias("query_id"), "v", F.lit(float(np.arccos(0.95))).alias("reach"))
    visits = vector_index._visits(index, asked, 0, len(index))
    assert visits.count() < nodes.count() * len(index) * 0.5
    got = {(r.a, r.b) for r in vector_index.similar_pairs(index, 0.95).collect()}
    assert got == {(r.a, r.b) for r in vectors.similar_pairs(nodes, 0.95).collect()} and got


def test_candidates_and_recall(spark):
    nodes = table(spark, clusters(), "double")
    index = vector_index.build(nodes)
    assert {tuple(r) for r in vector_index.knn_candidates(index).select("source_id", "target_id").collect()} == {tuple(r) for r in vectors.knn_candidates(nodes).select("source_id", "target_id").collect()}
    probes = vector_index.probes_for(index, 0.95)
    assert probes < len(index)
    found = {(r.query_id, r.node_id) for r in vector_index.search(index, queries_of(nodes), 10, probes, skip_same=True).collect()}
    best = {(r.query_id, r.node_id) for r in vectors.best_matches(queries_of(nodes), nodes, 10, skip_same=True).collect()}
    assert len(found & best) >= 0.9 * len(best)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(7, [1.0, 0.0])], [(1, [0.0, 0.0]), (2, [0.0, 0.0])]])
def test_few_rows(spark, rows):
    nodes = table(spark, rows)
    index = vector_index.build(nodes)
    found = vector_index.search(index, queries_of(nodes), 3, 1, exact=True).collect()
    expect = vectors.best_matches(queries_of(nodes), nodes, 3).collect()
    assert sorted((r.query_id, r.node_id) for r in found) == sorted((r.query_id, r.node_id) for r in expect)
    assert vector_index.probes_for(index) >= 1
