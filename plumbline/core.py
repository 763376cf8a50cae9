"""Small helpers every operator shares: column kinds, missing values, attaching fitted rows."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    """Column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans count as categorical."""
    return isinstance(data_type, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    wanted = None if columns is None else set(columns)
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and (wanted is None or f.name in wanted)]


def numeric_features(df: DataFrame, exclude: Sequence[str] = ("label", "target", "class", ">50k")) -> DataFrame:
    """Numeric columns whose lower-cased name holds none of the excluded words."""
    return df.select([c for c in numeric_columns(df) if not any(w in c.lower() for w in exclude)])


def clean(df: DataFrame) -> DataFrame:
    """NaN is a missing value: turn it into NULL in every float column."""
    return df.select([
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def as_double(name: str) -> Column:
    return F.col(name).cast("double")


def total(terms: Iterable[Column]) -> Column:
    """Sum of columns; 0 for none."""
    out = None
    for t in terms:
        out = t if out is None else out + t
    return F.lit(0) if out is None else out


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def constant(value: float) -> Column:
    """An aggregate that is the same number for every group, the empty table included."""
    return F.coalesce(F.max(F.lit(value)), F.lit(value))


def ratio(num: Column, den: Column, default: float) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(default)))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on keys; the right side's key columns are dropped."""
    renamed = right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], name: str = "__s") -> DataFrame:
    """Join the fitted values of `stats` (one row per group) as one struct column.

    The join is null-safe; Spark broadcasts `stats` only when its size allows.
    """
    values = [c for c in stats.columns if c not in keys]
    return same_keys(df, stats.select(*keys, F.struct(*values).alias(name)), keys, "left")


@functools.cache
def _local_dir() -> str:
    """One folder per process, for local sessions without a checkpoint folder."""
    return tempfile.mkdtemp(prefix="plumbline-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """New folder below the cluster's shared checkpoint folder (a temporary one where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame once and read it back, so later jobs do not recompute it."""
    spark = df.sparkSession
    path = shared_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


COUNT = "__count"       # how many equal rows a row stands for


def count_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of the columns and how often they come, in COUNT; written once. Such a table is returned as it is.

    Equal rows meet before the shuffle, so a table of many copies is read once and small from there on.
    """
    if COUNT in df.columns:
        return df
    kinds = dict(df.dtypes)
    rows = clean(df.select(*[F.col(quoted(c)).cast("string").alias(c) if kinds.get(c) == "void" else F.col(quoted(c)) for c in columns]))
    return materialize(rows.groupBy(*[F.col(quoted(c)) for c in rows.columns]).agg(F.count(F.lit(1)).alias(COUNT)))


def settings(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of parameters (weights, thresholds), one row per setting."""
    return spark.createDataFrame(rows, schema)


SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give row-heavy work all cores when the input is too small to fill them with file splits.

    Larger tables are returned unchanged. Rows are placed by hash, so a repeated task gets the
    same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *df.columns) if 0 < size < cores * SPLIT_BYTES else df
