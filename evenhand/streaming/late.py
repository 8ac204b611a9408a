"""Accounts of late rows: every row read is on time, late but counted, or dropped into a side table.

Spark drops rows whose window has closed and says no more than how many. Here each micro-batch is split against the
watermark that the batches before it left, by the rule that Spark's own windows follow, and all three parts are kept.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.sources.tables import path_exists

ON_TIME, LATE, DROPPED = "on_time", "late", "dropped"


class LateSplit:
    """Splits a stream by the watermark, ``delay`` behind the newest row of earlier batches.

    A row is on time if it is not behind the watermark, late if it is but its window of ``width`` is still open, and
    dropped if its window has closed. Rows and watermarks are tables with one folder per batch id under ``folder``: a
    repeated batch meets the same watermark and replaces its own rows. Rows without a time are dropped.
    """

    def __init__(self, folder: str, time: str, width: str, delay: str):
        self.folder = folder.rstrip("/")
        self.time, self.width, self.delay = time, width, delay

    def _watermark_path(self, batch_id: int) -> str:
        return f"{self.folder}/watermark/batch_id={batch_id}"

    def watermark(self, spark: SparkSession, before: int | None = None) -> datetime | None:
        """The watermark that the batches before ``before``, or all of them, have left."""
        if not path_exists(spark, f"{self.folder}/watermark"):
            return None
        marks = spark.read.schema("batch_id int, watermark timestamp").parquet(f"{self.folder}/watermark")
        if before is not None:
            marks = marks.where(F.col("batch_id") < before)
        return marks.agg(F.max("watermark")).first()[0]

    def _status(self, watermark: datetime | None) -> Column:
        time = F.col(self.time)
        if watermark is None:
            return F.when(time.isNull(), DROPPED).otherwise(ON_TIME)
        mark = F.lit(watermark)
        return (
            F.when(time >= mark, ON_TIME).when(F.window(time, self.width)["end"] > mark, LATE).otherwise(DROPPED)
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self.watermark(spark, batch_id)
        path = f"{self.folder}/rows/batch_id={batch_id}"
        batch.withColumn("status", self._status(before)).write.mode("overwrite").partitionBy("status").parquet(path)
        if not path_exists(spark, path) or batch.isEmpty():
            return
        written = spark.read.schema(batch.schema).parquet(path)
        newest = written.agg((F.max(self.time).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")).alias("watermark"))
        after = newest.select(F.greatest("watermark", F.lit(before).cast("timestamp")).alias("watermark"))
        after.coalesce(1).write.mode("overwrite").parquet(self._watermark_path(batch_id))

    def run(self, rows: DataFrame) -> None:
        """Processes everything available and stops."""
        query = (
            rows.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        """All rows read so far, with batch_id and status."""
        full = spark.createDataFrame([], schema).withColumns({"batch_id": F.lit(0), "status": F.lit("")}).schema
        if not path_exists(spark, f"{self.folder}/rows"):
            return spark.createDataFrame([], full)
        return spark.read.schema(full).parquet(f"{self.folder}/rows")

    def counted(self, spark: SparkSession, schema) -> DataFrame:
        """The rows whose windows count them: on time or late."""
        return self.rows(spark, schema).where(F.col("status") != DROPPED)

    def side_table(self, spark: SparkSession, schema) -> DataFrame:
        """The rows that came after their window had closed."""
        return self.rows(spark, schema).where(F.col("status") == DROPPED)
