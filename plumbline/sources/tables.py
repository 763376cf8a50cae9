"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet or CSV (header row), chosen by the path's ending.

    CSV needs a schema: inferring one reads the whole input first.
    """
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def keep_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns an index knows, in its order; the scan reads no others."""
    return df.select([c for c in columns if c in df.columns])


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any missing value (NaN included)."""
    return df.na.drop(subset=columns)


def first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n rows with the smallest keys."""
    return df.orderBy(*key).limit(n)


def sample_rows(df: DataFrame, key: list[str], n: int | None = None, fraction: float | None = None,
                seed: int = 42) -> DataFrame:
    """Exactly n rows in the order of the MD5 of key and seed, or about a fraction of all rows."""
    if n is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.orderBy(F.md5(F.concat_ws("-", *key, F.lit(seed)).cast("binary")), *key).limit(n)
