"""Flat tables for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """One flat row per model, attribute and metric."""
    model = F.col("model") if "model" in metrics.columns else F.lit("default")
    return metrics.where(F.col("metric") != "risk_assessment").select(
        model.alias("model"),
        F.col("attribute").alias("protected_attribute"),
        F.col("metric_name").alias("metric"),
        "value",
        "threshold",
        "passed",
        "severity",
        "regulation",
    )


def flatten_predictions(
    scored: DataFrame, prediction: str, probability: str | None = None, label: str | None = None
) -> DataFrame:
    """Input columns plus prediction, its probability, the actual outcome and whether they agree."""
    extra: dict[str, Column] = {"prediction": F.col(prediction)}
    if probability is not None:
        extra["prediction_probability"] = F.col(probability)
    if label is not None:
        extra["actual"] = F.col(label)
        extra["correct"] = F.col(prediction) == F.col(label)
    spent = {c for c in (prediction, probability, label) if c is not None}
    kept = [c for c in scored.columns if c not in spent and c not in extra]
    return scored.select(*kept, *[c.alias(n) for n, c in extra.items()])


def write_export(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write an export as csv with a header or as json lines."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported export format: {fmt!r}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path
