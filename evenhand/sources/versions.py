"""Tables replaced without a moment in which neither the old nor the new rows can be read.

A write goes to a folder of its own, and only then a manifest names the folders that make up the table. Readers follow the newest complete
manifest, so a job that dies half-way leaves the old rows as they were. Replacing single partitions writes only
these; the manifest takes the others over from the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenhand.sources.tables import path_exists

MANIFEST = "version long, part string, folder string"


class VersionedTable:
    """A parquet table of replaceable partitions below ``path``. One writer at a time, any number of readers.

    ``partition_by`` names the columns whose values make up a partition, none for a table that is only replaced whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.partition_by = list(partition_by)

    def _manifests(self) -> DataFrame:
        """Rows of all complete manifests; a manifest is one file, which Spark moves into place when it is whole."""
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{self.path}/manifest")

    def version(self) -> int:
        """Number of the newest complete version, 0 if there is none."""
        return self._manifests().agg(F.coalesce(F.max("version"), F.lit(0).cast("long"))).first()[0]

    def _parts(self, version: int) -> DataFrame:
        return self._manifests().where(F.col("version") == version)

    def _part(self):
        """Name of a row's partition; NULL is a value of its own."""
        return F.to_json(F.struct(*self.partition_by), {"ignoreNullFields": "false"}) if self.partition_by else F.lit("all")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default. An empty table where nothing has been written."""
        number = self.version() if version is None else version
        parts = [(r["folder"], r["part"]) for r in self._parts(number).select("folder", "part").collect()]
        folders = sorted({f for f, _ in parts if f})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows

    def replace(self, df: DataFrame) -> int:
        """Makes ``df`` the table; returns the version's number."""
        return self._commit(df, keep=False)

    def replace_partitions(self, df: DataFrame) -> int:
        """Replaces the partitions that ``df`` has rows of and keeps the others."""
        if not self.partition_by:
            raise ValueError("a table without partition columns can only be replaced whole")
        return self._commit(df, keep=True)

    def _commit(self, df: DataFrame, keep: bool) -> int:
        number = self.version() + 1
        stage = f"data/{number}-{uuid.uuid4().hex}"
        numbered = df.select(*self.schema.names).withColumn("_part", self._part())
        # Each partition lies in a folder of its own, so that a later version can take it over by name.
        order = F.dense_rank().over(Window.orderBy("_part"))  # one row per partition of the table
        names = numbered.select("_part").distinct().withColumn("_folder", order)
        names.write.mode("overwrite").parquet(f"{self.path}/{stage}-names")
        names = self.spark.read.schema("_part string, _folder int").parquet(f"{self.path}/{stage}-names")
        numbered.join(names, "_part").drop("_part").write.mode("overwrite").partitionBy("_folder").parquet(f"{self.path}/{stage}")
        new = names.select(F.lit(number).cast("long").alias("version"), F.col("_part").alias("part"), F.concat(F.lit(f"{stage}/_folder="), F.col("_folder").cast("string")).alias("folder"))
        if keep:
            old = self._parts(number - 1).join(new.select("part"), "part", "left_anti")
            new = new.unionByName(old.select(F.lit(number).cast("long").alias("version"), "part", "folder"))
        # An empty version has a row as well, which names no folder.
        none = self.spark.createDataFrame([(number, "", None)], MANIFEST)
        new.unionByName(none).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        return number
