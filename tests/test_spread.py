from pyspark.sql import functions as F

from geograph.plans import feed_queries, queries


def test_heavy_rows_are_dealt_to_all_tasks(spark):
    """Facts and pages of small tables are read by as many tasks as a shuffle has, adaptive sizes or not."""
    for made in (queries.flat_nodes, feed_queries._order_pages):
        parts = made(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
