"""Submissions and embeddings as micro-batch jobs over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.nodes import embed_pending
from ..operators.review import validate_submissions
from ..operators.vectors import embed


def intake(spark: SparkSession, source: str, schema, valid_path: str, rejects_path: str, checkpoint: str) -> StreamingQuery:
    """Validate new submission files once each: valid rows and rejects are appended as
    Parquet, in a folder named after the batch, so that a batch that runs again
    overwrites what it wrote."""

    def write(batch: DataFrame, epoch: int) -> None:
        valid, rejects = validate_submissions(batch)
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={epoch}")
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={epoch}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def promote_stream(approved: DataFrame, promote: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Promote approved submissions batch by batch; each table of the outcome is written to
    its own folder, one sub-folder a batch. Ids follow from the submissions, so a
    batch that runs again gives the same rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        for name, table in promote(batch).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={epoch}")

    return approved.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_backlog(nodes: DataFrame, text_col: str = "content") -> DataFrame:
    """Vectors of the active nodes that have none: the null vector is the queue of work."""
    return embed(embed_pending(nodes).select("node_id", text_col), text_col, out_col="vector_embedding").drop(text_col)
