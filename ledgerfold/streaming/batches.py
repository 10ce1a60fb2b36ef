"""Batches of several tables, each written by one Spark job.

A batch is a folder ``batch_id=N`` whose rows carry the name of their table, with one column (a struct) for each table: events and
what was derived from them are output of one job, so an error anywhere leaves nothing of the batch. A batch that runs again overwrites its folder, and
what it is made from are earlier batches only, so it gives the same rows. A job that is lost while it publishes its files leaves a part, which the stream's next
start overwrites; readers that mustn't see that name the last batch they want. Nothing else is kept: no markers, no lists of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Batches:
    """Tables below root, by name and schema (DDL). New columns and tables may be added; earlier batches have null there."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        unknown = set(tables) - set(self.tables)
        if unknown:
            raise ValueError(f"tables without a schema: {sorted(unknown)}")
        rows = [self._rows(name, df) for name, df in tables.items()]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        out.write.mode("overwrite").partitionBy("table").parquet(f"{self.root}/batch_id={batch_id}")

    def _rows(self, name: str, df: DataFrame) -> DataFrame:
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.tables[name]).schema]
        return df.select(F.lit(name).alias("table"), F.struct(*typed).alias(name))

    def read(self, name: str, before: int | None = None, since: int | None = None) -> DataFrame:
        """A table's rows with batch_id, of batches from since on and before another one; only their folders are read."""
        schema = f"`{name}` struct<{self.tables[name]}>, `table` string, batch_id int"
        try:
            rows = self.spark.read.schema(schema).parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)
        wanted = F.col("table") == name
        if before is not None:
            wanted &= F.col("batch_id") < before
        if since is not None:
            wanted &= F.col("batch_id") >= since
        return rows.where(wanted).select(f"`{name}`.*", "batch_id")
