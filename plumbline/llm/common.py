"""Helpers the text operators share: row identity, words, bounded samples, tables written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty) of a table, so that other columns never clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: str = "text") -> str:
    """SQL that lower-cases A to Z and nothing else."""
    return f"translate({text}, '{_A_TO_Z}', '{_A_TO_Z.lower()}')"


def words_of(pattern: str, text: str = "text") -> Column:
    """Array of the matches of a pattern. The condition always holds; having it keeps the array a column of its own, as
    the optimizer would else copy the expression into every filter and every lambda above, and split again per word."""
    return F.expr(f"regexp_extract_all(if(spark_partition_id() >= 0, {text}, null), r'{pattern}', 0)")


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(modulus)) == remainder, F.lit(False))


def sample_of(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most `limit` rows, the same ones on every run: those with the smallest hash of the keys."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(limit)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, with its least text: repeats of an id go before features are made, and before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in spark.checkpoint.dir; only a session in one process may leave that unset, as tests do."""
    return shared_dir(spark, label)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: later jobs start from files."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
