"""Helpers shared by the corpus operators: shared folders, staged tables and
distributed running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, as named in spark.checkpoint.dir.

    Only a local session (as in tests) may leave the setting out; it gets a
    temporary folder then.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not the work above,
    and what an unstable order or a sample decided stays decided.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(
    df: DataFrame, value: str, order: list[str], group: list[str] | None = None, label: str = "running"
) -> DataFrame:
    """Add `start`: the sum of `value` over all rows before this one in its group.

    No task ever needs a whole group: rows are range-partitioned by (group,
    order), each partition keeps its own running sum, and only one total per
    partition and group is summed across partitions. df should be cheap to
    compute (range partitioning samples it first). Null group values form a
    group of their own; equal rows take any order among themselves.
    """
    group = group or []
    spark = df.sparkSession
    keyed = df.withColumn("_g", F.xxhash64(*[F.col(c) for c in group], *[F.col(c).isNull() for c in group]) if group else F.lit(0).cast("long"))
    keys = ["_g", *group, *order]
    ranged = keyed.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*keyed.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_run", T.LongType())])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("_g").to_numpy(zero_copy_only=False)
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            base = before[first].copy()
            if last is not None and g[0] == last:
                base[0] -= carry
            run = before - np.repeat(base, np.diff(np.r_[first, len(g)]))
            last, carry = g[-1], int(run[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), pid, np.int32)), pa.array(run)], names=[*b.schema.names, "_pid", "_run"])

    staged = stage_table(ranged.mapInArrow(accumulate, schema), label)
    totals = staged.groupBy("_pid", "_g").agg(F.sum(value).alias("_total"))
    w = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_pid", "_g", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_base"))
    joined = staged.join(bases.hint("merge"), ["_pid", "_g"])  # a staged table looks smaller than it is, so neither side is broadcast
    return joined.withColumn("start", F.col("_run") + F.col("_base")).drop("_pid", "_g", "_run", "_base")


def row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Number rows in a task: (task id << 40) + position. Stable once staged."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for b in batches:
        yield np.arange(at, at + b.num_rows, dtype=np.int64), b
        at += b.num_rows


def unit_noise(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
