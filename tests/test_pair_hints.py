from geograph.plans import queries


def test_hints_shuffle_no_pairs(spark):
    """Facts go with the points: one join, of points in cells."""
    plan = queries.pair_hints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
