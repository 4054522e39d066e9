"""Results that are computed once and kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder, or the one that spark.checkpoint.dir names. Only a
    local session may do without; it gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many tasks as a shuffle has, for work that is heavy a row: sizes in bytes would leave it to few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed: computed once, its lineage cut, and safe from lost executors."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """(df, its folder): written as a table and read back. For loops: a checkpoint keeps the
    planner's estimates of its origin, which each round's joins multiply."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(df: DataFrame, *paths: str) -> None:
    """Delete tables of written() that nothing reads any more."""
    for path in paths:
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)
