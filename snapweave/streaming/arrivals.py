"""Releases that arrive as a stream of rows: each micro-batch is a release, compared with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff as D


def diff_arrivals(stream: DataFrame, state: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes every release's events against the last one to ``out``/batch=N.

    ``stream`` has genetic_id, individual_id, group_id and row_idx. Releases are
    kept under ``state`` by batch number. A batch that is run again overwrites
    what it wrote, so each release is compared once whatever fails.
    """

    def compare(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.withColumn("canonical", F.col("individual_id"))
        now.write.mode("overwrite").parquet(f"{state}/batch={number}")
        now = spark.read.parquet(f"{state}/batch={number}")
        before = spark.read.parquet(f"{state}/batch={number - 1}") if number else now.where("false")
        renames = spark.createDataFrame([], "canonical string, mid_old string, mid_new string, via_genetic_id string")
        D.report(D.paired(before, now), renames).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
