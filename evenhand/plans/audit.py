"""The full audit as one job: metrics, risk, rules and alerts of every segment, stored as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from evenhand.operators import fairness, risk
from evenhand.sources.exports import flatten_metrics, write_export


def run_audit(
    applications: DataFrame,
    folder: str,
    attributes: Sequence[str],
    outcomes: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
    references: Mapping[str, str] | None = None,
    thresholds: Mapping[str, Mapping] | None = None,
) -> dict[str, str]:
    """Audit one or more outcome columns (``{model name: column}``) and write the results.

    The metrics are stored first and everything else is derived from that small table, so the
    applications are read once. Returns the path of each table; ``flat`` is the csv
    export.
    """
    outcomes = dict(outcomes or {"history": "approved"})
    folder = folder.rstrip("/")
    paths = {name: f"{folder}/{name}" for name in ("metrics", "risk", "rules", "alerts", "flat")}
    audit = fairness.audit_models(applications, attributes, outcomes, by, references, thresholds)
    audit.write.mode("overwrite").parquet(paths["metrics"])
    metrics = applications.sparkSession.read.parquet(paths["metrics"])
    keys = ["model", *by]
    risk.risk_score(metrics, keys).write.mode("overwrite").parquet(paths["risk"])
    risk.triggered_rules(metrics, keys).write.mode("overwrite").parquet(paths["rules"])
    risk.portfolio_alerts(metrics, keys).write.mode("overwrite").parquet(paths["alerts"])
    write_export(flatten_metrics(metrics), paths["flat"], "csv")
    return paths
