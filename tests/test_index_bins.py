import numpy as np
from pyspark.sql import functions as F

from geograph.operators import vector_index, vectors


def test_a_query_goes_to_a_bin_once(spark, monkeypatch):
    """Random directions, where every cell is read: what is shuffled grows with the bins, not with the cells, and two bins meet once."""
    monkeypatch.setattr(vector_index, "BIN", 120)
    rows = np.random.default_rng(8).normal(size=(600, 12))
    nodes = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(rows)], "node_id string, embedding array<double>")
    index = vector_index.build(nodes)
    asked = index.rows.select(F.col("node_id").alias("query_id"), "v", F.lit(float(np.arccos(0.3))).alias("reach"), F.col("bin").alias("home"))
    bins = int(index.bins.max()) + 1
    assert 3 < bins < len(index)
    assert vector_index._visits(index, asked.drop("home"), 0, len(index)).count() <= 600 * bins
    assert vector_index._visits(index, asked, 0, len(index)).count() <= 0.7 * 600 * bins
    got = [(r.a, r.b, round(r.similarity, 9)) for r in vector_index.similar_pairs(index, 0.6).collect()]
    assert sorted(got) == sorted((r.a, r.b, round(r.similarity, 9)) for r in vectors.similar_pairs(nodes, 0.6).collect()) and got
