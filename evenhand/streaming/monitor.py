"""The monitoring cycle as Structured Streaming jobs.

Every job takes a streaming DataFrame, keeps its state in Spark's state store or in tables written
once per batch id, and can be stopped and restarted from its checkpoint without counting or
alerting twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenhand.operators.drift import (
    KEYS,
    SMOOTHING,
    all_drift,
    drift_alerts,
    drift_summary,
    snapshot_cells,
    snapshots_from_cells,
)
from evenhand.sources.tables import is_folder, path_exists


def table_stream(
    spark: SparkSession, folder: str, file_glob: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of the parquet files in ``folder`` that match ``file_glob``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stored_table_stream(spark: SparkSession, base: str, name: str, schema: StructType) -> DataFrame:
    """Stream of the table ``base/name``, whether that is one file or a folder of files."""
    path = f"{base.rstrip('/')}/{name}"
    if is_folder(spark, path):
        return table_stream(spark, path, "*", schema)
    return table_stream(spark, base, name, schema)


def windowed_counts(
    rows: DataFrame,
    time: str,
    groups: Sequence[str],
    sums: Mapping[str, Column],
    width: str,
    delay: str | None = None,
    slide: str | None = None,
) -> DataFrame:
    """Counters per event-time window and group; the same code for a table and for a stream.

    ``delay`` sets the watermark: a stream drops rows whose window has closed by then.
    """
    if delay is not None:
        rows = rows.withWatermark(time, delay)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return _flat(rows.groupBy(window.alias("w"), *groups).agg(*_aggregates(sums)), groups, sums)


def session_counts(
    rows: DataFrame,
    time: str,
    groups: Sequence[str],
    sums: Mapping[str, Column],
    gap: str,
    delay: str | None = None,
) -> DataFrame:
    """Counters per session: rows of a group less than ``gap`` apart."""
    if delay is not None:
        rows = rows.withWatermark(time, delay)
    session = F.session_window(time, gap).alias("w")
    return _flat(rows.groupBy(session, *groups).agg(*_aggregates(sums)), groups, sums)


def _aggregates(sums: Mapping[str, Column]) -> list[Column]:
    return [F.sum(c).alias(n) for n, c in sums.items()]


def _flat(counts: DataFrame, groups: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *groups, *sums)


def drain_append(counts: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available; returns the closed windows it has written."""
    spark = counts.sparkSession
    query = (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/table")


def drain_complete(counts: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available; returns all windows, open ones included.

    Each batch writes the whole result under its own id, so a repeated batch replaces itself.
    """
    spark = counts.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    while last > 0 and not path_exists(spark, f"{folder}/table/batch_id={last}"):
        last -= 1
    return spark.read.schema(counts.schema).parquet(f"{folder}/table/batch_id={last}")


def smoothed(previous: DataFrame | None, current: DataFrame, alpha: float = SMOOTHING) -> DataFrame:
    """Baseline after one more snapshot.

    The first snapshot becomes the baseline. Later ones are smoothed into the keys the baseline
    has, except for group shares, which stay; keys new to the baseline are added as they are.
    """
    if previous is None:
        return current.select(*KEYS, "value")
    old = previous.select(*KEYS, F.col("value").alias("old"))
    new = current.where(F.col("family") != "share").select(*KEYS, F.col("value").alias("new"))
    mixed = F.lit(alpha) * F.col("new") + F.lit(1.0 - alpha) * F.col("old")
    return old.join(new, list(KEYS), "full").select(*KEYS, F.coalesce(mixed, "old", "new").alias("value"))


class DriftMonitor:
    """Drift detection per micro-batch against a smoothed baseline.

    Each batch is compared with the baseline left by the batch before it and then updates it.
    Baselines and alerts are tables with one folder per batch id under ``folder``; a repeated batch
    reads the same predecessor and overwrites its own folders.
    """

    def __init__(self, folder: str, attributes: Sequence[str], label: str = "approved", prediction: str = "predicted"):
        self.folder = folder.rstrip("/")
        self.attributes = list(attributes)
        self.label, self.prediction = label, prediction

    def _baseline_path(self, batch_id: int) -> str:
        return f"{self.folder}/baseline/batch_id={batch_id}"

    def _previous(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        for earlier in range(batch_id - 1, -1, -1):
            if path_exists(spark, self._baseline_path(earlier)):
                return spark.read.parquet(self._baseline_path(earlier))
        return None

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = snapshot_cells(batch, self.attributes, self.label, self.prediction, by=()).persist()
        current = snapshots_from_cells(table, self.attributes, by=()).persist()
        try:
            if current.isEmpty():
                return
            previous = self._previous(spark, batch_id)
            if previous is not None:
                drifts = all_drift(current, previous, by=())
                alerts = drift_alerts(drift_summary(drifts, by=()), by=())
                alerts.write.mode("overwrite").parquet(f"{self.folder}/alerts/batch_id={batch_id}")
            updated = smoothed(previous, current).coalesce(1)
            updated.write.mode("overwrite").parquet(self._baseline_path(batch_id))
        finally:
            current.unpersist()
            table.unpersist()

    def run(self, applications: DataFrame) -> None:
        """Process everything available and stop."""
        query = (
            applications.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def alerts(self, spark: SparkSession) -> DataFrame:
        schema = "batch_id int, type string, severity string, message string, drift string"
        if not path_exists(spark, f"{self.folder}/alerts"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/alerts")

    def baselines(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/baseline")
