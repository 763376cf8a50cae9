"""Monitoring of streams with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..core import as_double, clean, count_if, numeric_columns, ratio, total
from ..operators.alerts import alerts
from ..operators.index import QualityIndex


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder, with a given schema."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(stream: DataFrame, index: QualityIndex, key: str, thresholds: dict | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Alerts of a stream: row by row, without state.

    `partitions` spreads the rows of a source that hands out few large files.
    """
    needed = [c for c in stream.columns if c in index.inputs or c == key]
    if partitions:
        stream = stream.select(*needed).repartition(partitions)
    return alerts(index.transform(stream.select(*needed)), key, thresholds)


def start_alert_log(found: DataFrame, log: str, checkpoint: str, form: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Write alerts to a file sink: every alert exactly once, also after a restart."""
    writer = found.writeStream.format(form).option("path", log).option("checkpointLocation", checkpoint).outputMode("append")
    if form == "csv":
        writer = writer.option("header", True)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_monitor(stream: DataFrame, index: QualityIndex, key: str, log: str, summaries: str, checkpoint: str,
                  thresholds: dict | None = None, available_now: bool = True,
                  on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Score, write alerts and one summary row per micro-batch.

    A batch writes to a folder of its own and replaces it when run again, so a retried batch leaves
    no second copy.
    """
    needed = [c for c in stream.columns if c in index.inputs or c == key]

    def handle(batch: DataFrame, batch_id: int) -> None:
        start = time.perf_counter()
        scored = index.transform(batch).persist()
        try:
            found = alerts(scored, key, thresholds)
            found.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
            n = scored.count()
            seconds = time.perf_counter() - start
            written = batch.sparkSession.read.schema(found.schema).parquet(f"{log}/batch={batch_id}")
            summary = batch_summary(written, n, seconds).withColumn("batch", F.lit(batch_id).cast("bigint"))
            summary.write.mode("overwrite").parquet(f"{summaries}/id={batch_id}")
            if on_batch is not None:
                on_batch(written, batch_id)
        finally:
            scored.unpersist()

    writer = stream.select(*needed).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_summary(found: DataFrame, n: int, seconds: float | None = None) -> DataFrame:
    """n_tuples, n_alerts, alerts per tuple, and with the time a batch took also its seconds and rows_per_second."""
    out = found.agg(F.lit(n).cast("bigint").alias("n_tuples"), F.count(F.lit(1)).alias("n_alerts")).withColumn(
        "alert_rate", F.col("n_alerts") / F.lit(float(max(n, 1))))
    if seconds is None:
        return out
    return out.withColumns({"seconds": F.lit(float(seconds)), "rows_per_second": F.lit(n / seconds if seconds > 0 else 0.0)})


def throughput(query: StreamingQuery) -> DataFrame:
    """batch, n_tuples, seconds, rows_per_second of the batches whose progress a query still reports (Spark keeps the last 100)."""
    rows = []
    for p in query.recentProgress:
        took = p["durationMs"].get("triggerExecution", 0) / 1000
        rows.append((int(p["batchId"]), int(p["numInputRows"]), took, p["numInputRows"] / took if took else 0.0))
    return SparkSession.active().createDataFrame(rows, "batch bigint, n_tuples bigint, seconds double, rows_per_second double")


def window_metrics(stream: DataFrame, ts: str, columns: Sequence[str], limits: dict[str, tuple[float, float]],
                   width: str = "1 day", late: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Completeness and outlier rate per tumbling event-time window (and keys).

    Outlier limits are fitted on history beforehand: a stream cannot be read twice.
    """
    cols = list(columns)
    numeric = [c for c in numeric_columns(stream, cols) if c in limits]
    rows = clean(stream).withColumn(ts, F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark(ts, late)
    bad = total(count_if((as_double(c) < limits[c][0]) | (as_double(c) > limits[c][1])) for c in numeric)
    out = rows.groupBy(F.window(ts, width), *keys).agg(
        F.count(F.lit(1)).alias("n"), ratio(total(F.count(c) for c in cols), F.count(F.lit(1)) * len(cols), 1.0).alias("completeness"),
        ratio(bad, F.count(F.lit(1)) * max(len(numeric), 1), 0.0).alias("outlier_rate"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "completeness", "outlier_rate")


def start_window_log(result: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each batch's changed windows to a folder of its own, by day of the window.

    The query runs in update mode: a window whose end the watermark has passed leaves the state for good, and rows that
    come later than the watermark allows are dropped, so the state holds only windows that can still change.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("window_day", F.to_date("window_start"))
        dated.write.mode("overwrite").partitionBy("window_day").parquet(f"{path}/batch={batch_id}")

    writer = result.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_window_log(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The last state of every window in a window log."""
    found = spark.read.option("basePath", path).option("recursiveFileLookup", "false").schema(
        T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("window_day", T.DateType())])).parquet(f"{path}/batch=*")
    last = found.groupBy("window_start", *keys).agg(F.max_by(F.struct(*[f.name for f in schema.fields]), "batch").alias("row"))
    return last.select("row.*")


def run_to_table(result: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream of window metrics over all available input and read its windows."""
    start_window_log(result, path, checkpoint).awaitTermination()
    return read_window_log(result.sparkSession, path, result.schema, keys)
