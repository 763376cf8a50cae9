"""Saving and loading an index, training data, thresholds, alerts and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.forest import Forest
from ..operators.index import IndexParams, QualityIndex, params_dict
from ..operators.rows import RowMetricsModel

BINS_SCHEMA = "attr string, bin_id int, lower double, upper double, quality map<string,double>"


def save_index(index: QualityIndex, spark: SparkSession, path: str) -> None:
    """The forest's nodes, the bins and the codes of text values as parquet, everything else as one JSON row."""
    index.model.save(spark, f"{path}/model")
    rows = [(a, i, float(index.boundaries[a][i]), float(index.boundaries[a][i + 1]), q)
            for a, qs in index.quality.items() for i, q in enumerate(qs)]
    spark.createDataFrame(rows, BINS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/bins")
    for i, mapping in enumerate(index.categories.values()):
        mapping.write.mode("overwrite").parquet(f"{path}/categories/{i}")
    head = {"features": index.features, "categories": list(index.categories), "metrics": index.metrics, "params": params_dict(index.params),
            "row_model": index.row_model.to_json(), "fit_metrics": index.fit_metrics, "info": index.info}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load_index(spark: SparkSession, path: str) -> QualityIndex:
    """Fails when the bins are missing."""
    head = json.loads(spark.read.text(f"{path}/head").first()["value"])
    boundaries, quality = {}, {}
    for r in spark.read.schema(BINS_SCHEMA).parquet(f"{path}/bins").orderBy("attr", "bin_id").collect():
        boundaries.setdefault(r["attr"], [r["lower"]]).append(r["upper"])
        quality.setdefault(r["attr"], []).append(dict(r["quality"]))
    if set(boundaries) != set(head["features"]):
        raise ValueError(f"{path} holds no complete bins")
    head["params"]["thresholds"] = {m: tuple(v) for m, v in head["params"]["thresholds"].items()}
    order = head["features"]
    return QualityIndex(order, {a: boundaries[a] for a in order}, {a: quality[a] for a in order}, head["metrics"],
                        Forest.load(spark, f"{path}/model"), RowMetricsModel.from_json(head["row_model"]),
                        IndexParams(**head["params"]), [tuple(r) for r in head["fit_metrics"]], head["info"],
                        {c: spark.read.parquet(f"{path}/categories/{i}") for i, c in enumerate(head["categories"])})


def save_training_data(training: DataFrame, path: str) -> None:
    training.write.mode("overwrite").parquet(path)


def load_training_data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_metadata(index: QualityIndex, spark: SparkSession, path: str) -> DataFrame:
    """One-row JSON file of counts, features, bins, utilization, errors and time."""
    meta = index.metadata()
    schema = ("n_features_total int, n_features_selected int, selected_features array<string>, total_bins int, budget int, "
              "budget_utilization double, model_type string, n_estimators int, max_depth int, test_r2 double, test_mse double, "
              "metric_names array<string>, build_time double")
    row = spark.createDataFrame([{n.split()[0]: meta.get(n.split()[0]) for n in schema.split(", ")}], schema)
    row.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema(schema).json(path)


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_thresholds(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """JSON object metric -> {warning, critical}; a handful of settings."""
    row = spark.read.option("multiLine", True).json(path).first()
    return {m: {k: float(v) for k, v in limits.asDict().items() if v is not None} for m, limits in row.asDict().items()}


def write_alert_log(found: DataFrame, path: str, form: str = "csv") -> None:
    """Append alerts with a header row per file."""
    writer = found.write.mode("append")
    (writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path))


ALERT_SCHEMA = "ts timestamp, tuple_id {key_type}, metric string, predicted_value double, threshold double, severity string"


def read_alert_log(spark: SparkSession, path: str, form: str = "csv", key_type: str = "bigint") -> DataFrame:
    """`key_type` is the SQL type of the key that the alerts were written with."""
    reader = spark.read.schema(ALERT_SCHEMA.format(key_type=key_type))
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
