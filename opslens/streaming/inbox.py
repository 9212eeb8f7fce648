"""A folder of arriving log lines, kept as severity counts per log and hour, and incident upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opslens.operators.log_signals import line_signals
from opslens.operators.store import as_incidents, incident_state, merged_state, remove_folder, replace_table


def arriving(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def severity_counts(lines: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """log_path, window, severity, n of a stream (or table) of log_path, line_no, line, received_at; later lines than ``late`` are dropped by the watermark."""
    # line_signals keeps these columns only, so the time rides along in the path column's struct
    timed = lines.withColumn("log_path", F.struct("log_path", F.col("received_at").cast("timestamp").alias("at")))
    s = line_signals(timed).select(F.col("log_path.log_path").alias("log_path"), F.col("log_path.at").alias("at"), "severity")
    return s.withWatermark("at", late).groupBy("log_path", F.window("at", width), "severity").agg(F.count("*").alias("n"))


def keep_incidents(updates: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Streams incident updates into a table of the incidents that they make.

    Repeats are dropped by the stream's state. A batch is merged into the state that the batch
    before it left, a row per log, so no batch reads the updates of earlier ones; a batch that
    runs again starts from the same state.
    """
    fresh = updates.select("log_path", "top_node_key", "confidence", "at", "loaded_at").dropDuplicates()

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, state = batch.sparkSession, incident_state(batch)
        if batch_id > 0:
            state = merged_state(spark.read.parquet(f"{table}/state/{batch_id - 1}"), state)
        state.write.mode("overwrite").parquet(f"{table}/state/{batch_id}")
        replace_table(as_incidents(spark.read.parquet(f"{table}/state/{batch_id}")), f"{table}/incidents")
        if batch_id > 1:
            remove_folder(spark, f"{table}/state/{batch_id - 2}")

    w = fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
