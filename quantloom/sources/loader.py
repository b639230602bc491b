"""Loading of named datasets with pushed-down predicates and pruned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import REGISTRY


class DatasetLoader:
    """Datasets below a folder, one parquet path for each name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def scan(self, name: str, start: str | None = None, end: str | None = None, ids: list[int] | DataFrame | None = None) -> DataFrame:
        """Lazy; predicates on columns that the table lacks are ignored.  ``ids`` may be a table of its own."""
        if name not in REGISTRY:
            raise KeyError(name)
        return select_rows(self.spark.read.parquet(f"{self.folder}/{name}.parquet"), start, end, ids)

    def load(self, name: str, start: str | None = None, end: str | None = None, ids: list[int] | DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
        """Like ``scan``; with columns their keys stay, without them the table is validated."""
        df = self.scan(name, start, end, ids)
        if columns is None:
            schema = REGISTRY[name]
            return schema.validate(df)
        keys = [k for k in REGISTRY[name].keys if k in df.columns]
        return df.select(*dict.fromkeys([*keys, *columns]))


def select_rows(df: DataFrame, start: str | None = None, end: str | None = None, ids: list[int] | DataFrame | None = None) -> DataFrame:
    if "date" in df.columns:
        if start is not None:
            df = df.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if ids is not None and "id" in df.columns:
        df = df.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else df.where(F.col("id").isin(ids))
    return df


def batch(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """The same files as a stream of bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
