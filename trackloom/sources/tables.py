"""Reading and writing of the tables that stages hand on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Layout:
    """Where a scene's tables are: data_dir/{raw,interim,processed}/scene/table."""

    data_dir: str
    scene: str

    def path(self, stage: str, table: str) -> str:
        if stage not in ("raw", "interim", "processed"):
            raise ValueError(f"no such stage: {stage}")
        return f"{self.data_dir}/{stage}/{self.scene}/{table}"


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> int:
    """Overwrites; returns the number of rows, counted from the files' footers."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def write_csv(df: DataFrame, path: str, first: str | None = None) -> None:
    """With a header; a group's key can be made the first column."""
    columns = [first, *(c for c in df.columns if c != first)] if first else df.columns
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_parameters(df: DataFrame, path: str) -> None:
    """A table of one row, as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if nothing can be read there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def first_there(spark: SparkSession, paths: list[str]) -> tuple[str, DataFrame]:
    """The first of several tables that is there."""
    for path in paths:
        if (found := if_there(spark, path)) is not None:
            return path, found
    raise FileNotFoundError(f"none of these can be read: {', '.join(paths)}")
