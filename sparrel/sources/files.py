"""Sources: what gives the table of a model as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Source(Protocol):
    def table(self, model: Any) -> DataFrame: ...


class ParquetFolder:
    """A folder with `<table>.parquet` for each table, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def table(self, model: Any) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{model.table}.parquet")


class Frames:
    """DataFrames by table name, for tests and for what is no file."""

    def __init__(self, frames: Mapping[str, DataFrame]) -> None:
        self.frames = dict(frames)

    def table(self, model: Any) -> DataFrame:
        return self.frames[model.table]


class Jdbc:
    """Tables of a database by JDBC; its driver must be on Spark's class path. With a numeric key and
    its bounds, tables are read in partitions. Databases compare text in ways of their own (without its last
    blanks, or without case), so they get the conditions on other columns only, unless push_text is set."""

    def __init__(self, spark: SparkSession, url: str, *, options: Mapping[str, str] | None = None, partitions: Mapping[str, tuple[str, int, int, int]] | None = None, push_text: bool = False) -> None:
        self.spark, self.url, self.options, self.partitions, self.push_text = spark, url, dict(options or {}), dict(partitions or {}), push_text

    def reader_options(self, table: str) -> dict[str, str]:
        out = {"url": self.url, "dbtable": table, **self.options}
        if table in self.partitions:
            column, low, high, n = self.partitions[table]
            out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
        return out

    def table(self, model: Any) -> DataFrame:
        df = self.spark.read.format("jdbc").options(**self.reader_options(model.table)).load()
        if self.push_text:
            return df
        # a concat of one column changes no value, but no condition on it goes to the database
        return df.select(*(F.concat(f"`{c}`").alias(c) if kind == "string" else f"`{c}`" for c, kind in df.dtypes))
