import numpy as np

from geograph.operators import review, vectors


def test_equal_vectors_are_met_once_with_the_same_results(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kinds = rng.integers(-2, 3, (700, 6)).astype(float).tolist()
    made = lambda n, name: [(f"{name}{i:05d}", kinds[(i * 7) % len(kinds)] if i % 50 else None) for i in range(n)]
    asked = spark.createDataFrame(made(1500, "q"), "query_id string, embedding array<double>")
    there = spark.createDataFrame([*made(1100, "n"), ("n99999", [1.0, float("nan")]), ("n99998", [1.0, 1.0])], "node_id string, embedding array<double>")
    met = []
    plain = vectors.best_matches
    monkeypatch.setattr(vectors, "best_matches", lambda q, n, *a, **k: met.append((q.count(), n.count())) or plain(q, n, *a, **k))
    q, n = vectors.alike(asked, "query_id"), vectors.alike(there, "node_id")
    rows = lambda df, *c: sorted(map(tuple, df.select("query_id", "node_id", *c).collect()))
    assert rows(vectors.best_alike(q, n, 4, 0.35), "similarity", "rank") == rows(plain(asked, there, 4, 0.35), "similarity", "rank")
    assert rows(vectors.best_alike(q, n, None, 0.97)) == rows(plain(asked, there, None, 0.97))
    assert all(x <= 700 for x, _ in met)
    some = asked.where("query_id like '%1'").selectExpr("query_id as id")
    assert rows(vectors.best_alike(q, n, 2, only=some)) == [r for r in rows(plain(asked, there, 2)) if r[0].endswith("1")]
    pairs = plain(asked, there, 9).select("query_id", "node_id")
    near = {r[:2] for r in rows(plain(asked, there, None, 0.95))}
    assert rows(vectors.confirmed_alike(pairs, q, n, 0.95)) == [p for p in rows(pairs) if p in near]


def test_promotion_searches_for_different_vectors_only(spark, monkeypatch):
    there = vectors.embed(spark.createDataFrame([(f"n{i}", f"Site {i}", "deep water") for i in range(40)], "node_id string, title string, content string"), "content")
    subs = spark.createDataFrame([(f"s{i}", f"Found {i}", "deep water", None, 1.0, 2.0, None) for i in range(30)], "submission_id string, title string, description string, category string, latitude double, longitude double, contributor_note string")
    met = []
    plain = vectors.best_matches
    monkeypatch.setattr(vectors, "best_matches", lambda q, n, *a, **k: met.append((q.count(), n.count())) or plain(q, n, *a, **k))
    none = spark.createDataFrame([], "node_id string, other_id string, connect boolean, tier string, rationale string")
    out = review.promote(vectors.embed(review.derive_nodes(subs), "content"), there, none, none)["outcome"]
    assert out.where("status = 'added'").count() == 30 and met == [(1, review.NEIGHBOURS)]
