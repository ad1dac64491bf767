"""The growing log folder as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moltable.operators import runs
from moltable.operators.runs import best_validation
from moltable.sources.readers import log_name, stream_log_lines


def stream_best_validation(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Best validation scores per log, kept up to date as files arrive.

    Takes all files that are there, then stops; start it again with the same checkpoint for more.
    State is one row per log. Each run of the trigger writes the full table below ``out``.
    """
    lines = spark.readStream.text(f"{folder}/*.log").select(
        log_name(F.col("_metadata.file_path")).alias("file"), "value"
    )

    def write(table: DataFrame, epoch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        best_validation(lines)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_table(spark: SparkSession, out: str) -> DataFrame:
    """The table the last trigger wrote."""
    tables = spark.read.parquet(out)
    return tables.where(F.col("epoch") == tables.agg(F.max("epoch")).scalar()).drop("epoch")


def stream_log_state(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """What the log table and the run status need of each log, kept up to date as files and parts of logs arrive.

    Takes all files that are there, then stops; start it again with the same checkpoint for more. A line is read once.
    State is one row per log, and a trigger writes only the logs that it changed, below ``out``. A trigger that is run again
    after a loss overwrites what it wrote.
    """

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        runs.log_state(stream_log_lines(spark, folder))
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """The last row that any trigger wrote of each log."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in ("file", "epoch")]
    return rows.groupBy("file").agg(F.max_by(F.struct(*values), "epoch").alias("last")).select("file", "last.*")


def latest_log_table(spark: SparkSession, out: str, logs: DataFrame | None = None) -> DataFrame:
    """``log_table`` from the streamed state; ``logs`` (file) adds a row for each log without lines."""
    state = latest_state(spark, out).drop("succeeded", "failed")
    return runs.with_averages(state if logs is None else logs.select("file").join(state, "file", "left"))


def latest_status(spark: SparkSession, out: str, expected: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """``run_status`` from the streamed state."""
    return runs.status_of(latest_state(spark, out), expected, logs)
