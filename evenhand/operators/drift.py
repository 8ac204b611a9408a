"""Monitoring snapshots, drift against a baseline, and smoothed baselines.

A snapshot is one long table (segment columns, family, attribute, key, value). The same functions
serve event-time windows of a table and single micro-batches of a stream; they differ only in the
segment columns ``by``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.stats import ratio
from evenhand.operators.cube import COUNTERS, cells, cells_to_groups, decision_counters
from evenhand.operators.fairness import metric_table
from evenhand.operators.models import confusion_columns, performance_columns

# Drift limits (reported above the first, high above the second), smoothing and alert text.
APPROVAL_DRIFT = (0.05, 0.1)
SHARE_DRIFT = (0.1, 0.15)
FAIRNESS_DRIFT = (0.1, 0.15)
SMOOTHING = 0.1
ALERT_MESSAGE = "%s detected: %s drift detected in %d metrics"

WINDOW = ("window_start",)
KEYS = ("family", "attribute", "key")
OVERALL = "overall"
SEVERITIES = ("low", "medium", "high", "critical")
_CONFUSION = ("tp", "fp", "fn", "tn")


def with_window(
    df: DataFrame, time: str = "application_date", width: str = "30 days", slide: str | None = None
) -> DataFrame:
    """Adds ``window_start``, the start of the row's tumbling (or each sliding) event-time window."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withColumn("event_window", window).withColumn("window_start", F.col("event_window.start")).drop(
        "event_window"
    )


def snapshot_cells(
    df: DataFrame,
    attributes: Sequence[str],
    label: str = "approved",
    prediction: str = "predicted",
    by: Sequence[str] = WINDOW,
) -> DataFrame:
    """All sums a snapshot needs, per segment and combination of attribute values."""
    known = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    sums = decision_counters(known, prediction)
    sums |= {"labelled": F.col(label).cast("int")} | confusion_columns(label, prediction)
    return cells(known, attributes, sums, by)


def snapshots_from_cells(
    cell_table: DataFrame, attributes: Sequence[str], by: Sequence[str] = WINDOW
) -> DataFrame:
    """Snapshot rows: rates, shares, performance, fairness of the predictions, sample size.

    The cells feed two branches, so hand in a persisted or stored cell table.
    """
    sums = [*COUNTERS, "labelled", *_CONFUSION]
    with_all = cell_table.withColumn(OVERALL, F.lit("all"))
    groups = cells_to_groups(with_all, [OVERALL, *attributes], sums, by)
    is_overall = F.col("attribute") == OVERALL

    def entry(family: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), key.alias("key"), value.cast("double").alias("value"))

    overall_entries = [
        entry("statistical", F.lit("approval_rate"), ratio(F.col("labelled"), F.col("n"))),
        entry("statistical", F.lit("prediction_rate"), ratio(F.col("approvals"), F.col("n"))),
        entry("sample", F.lit("sample_size"), F.col("n")),
        *[entry("performance", F.lit(k), v) for k, v in performance_columns().items()],
    ]
    total = F.sum("n").over(Window.partitionBy(*by, "attribute"))
    group_entries = [entry("share", F.col("grp"), ratio(F.col("n"), F.col("total")))]
    counted = (
        groups.withColumn("total", total)
        .withColumn("e", F.explode(F.when(is_overall, F.array(*overall_entries)).otherwise(F.array(*group_entries))))
        .select(*by, "e.family", "attribute", "e.key", "e.value")
    )
    cube = cells_to_groups(cell_table, attributes, COUNTERS, by)
    fairness = metric_table(cube, by).select(
        *by, F.lit("fairness").alias("family"), "attribute", F.col("metric").alias("key"), "value"
    )
    return counted.unionByName(fairness).where(F.col("value").isNotNull())


def window_snapshots(
    df: DataFrame,
    attributes: Sequence[str],
    label: str = "approved",
    prediction: str = "predicted",
    by: Sequence[str] = WINDOW,
) -> DataFrame:
    """Snapshot of every segment; only its cells, a small aggregate, are cached."""
    table = snapshot_cells(df, attributes, label, prediction, by).persist()
    return snapshots_from_cells(table, attributes, by)


def _severity(amount: Column, limits: tuple[float, float]) -> Column:
    return F.when(amount > limits[1], "high").when(amount > limits[0], "medium")


def _drifts(compared: DataFrame, by: Sequence[str]) -> DataFrame:
    """Drift rows of compared values (by, family, attribute, key, baseline, current)."""
    amount = F.abs(F.col("current") - F.col("baseline"))
    family = F.col("family")
    is_approval = (family == "statistical") & (F.col("key") == "approval_rate")
    severity = (
        F.when(is_approval, _severity(amount, APPROVAL_DRIFT))
        .when(family == "share", _severity(amount, SHARE_DRIFT))
        .when(family == "fairness", _severity(amount, FAIRNESS_DRIFT))
    )
    metric = F.when(
        family == "share", F.concat_ws("_", F.lit("demographic_proportion"), "attribute", "key")
    ).otherwise(F.col("key"))
    return compared.select(
        *by,
        F.when(family == "fairness", "fairness_drift").otherwise("statistical_drift").alias("type"),
        "attribute",
        metric.alias("metric"),
        "baseline",
        "current",
        amount.alias("drift_amount"),
        severity.alias("severity"),
    ).where(F.col("severity").isNotNull())


def all_drift(current: DataFrame, baseline: DataFrame, by: Sequence[str] = WINDOW) -> DataFrame:
    """Statistical and fairness drift of every current segment against one baseline snapshot.

    A group the baseline lacks has baseline 0; a fairness metric it lacks is not compared. Groups
    only the baseline has are not looked at. An empty baseline gives no drift.
    """
    now = current.where(F.col("family").isin("statistical", "share", "fairness"))
    then = baseline.select(*KEYS, F.col("value").alias("then"))
    joined = now.join(then, list(KEYS), "left")
    exists = baseline.agg(F.count(F.lit(1))).scalar() > 0
    comparable = exists & ((F.col("family") != "fairness") | F.col("then").isNotNull())
    compared = joined.where(comparable).select(
        *by, *KEYS, F.coalesce("then", F.lit(0.0)).alias("baseline"), F.col("value").alias("current")
    )
    return _drifts(compared, by)


def statistical_drift(
    current: DataFrame, baseline: DataFrame, by: Sequence[str] = WINDOW, full: bool = False
) -> DataFrame:
    """Drift of the approval rate and of group shares.

    With ``full`` groups that vanished are reported too; this needs a single current snapshot.
    """
    statistics = F.col("family").isin("statistical", "share")
    now = current.where(statistics)
    if full:
        if by:
            raise ValueError("full comparison needs a single current snapshot")
        vanished = baseline.where(statistics).join(now, list(KEYS), "left_anti")
        now = now.unionByName(vanished.withColumn("value", F.lit(0.0)))
    return all_drift(now, baseline, by)


def fairness_drift(current: DataFrame, baseline: DataFrame, by: Sequence[str] = WINDOW) -> DataFrame:
    """Drift of fairness metrics present in both snapshots."""
    return all_drift(current.where(F.col("family") == "fairness"), baseline, by)


def ewma_baseline(
    snapshots: DataFrame, alpha: float = SMOOTHING, time: str = "window_start", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Exponentially smoothed value of every key up to and including each window.

    b0 = x0, bt = alpha xt + (1 - alpha) b(t-1). The recurrence runs over a bounded frame: it
    starts so far back that the weight of everything earlier is below double precision, so cost
    and memory per window do not grow with the length of the history.
    """
    reach = math.ceil(math.log(1e-18) / math.log(1.0 - alpha))
    frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(-reach, 0)
    history = F.collect_list("value").over(frame)
    smoothed = F.aggregate(
        F.slice(F.col("history"), F.lit(2), F.size("history")),
        F.col("history")[0],
        lambda b, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * b,
    )
    return (
        snapshots.withColumn("history", history)
        .withColumn("baseline", smoothed)
        .select(time, *keys, "value", "baseline")
    )


def drift_vs_previous(
    snapshots: DataFrame, alpha: float = SMOOTHING, time: str = "window_start"
) -> DataFrame:
    """Drift of every window against the baseline smoothed over the windows before it.

    As in a monitoring cycle the comparison comes first and the update second. Group shares are
    not smoothed: their baseline stays that of the first window.
    """
    per_key = Window.partitionBy(*KEYS).orderBy(time)
    smoothed = ewma_baseline(snapshots, alpha, time)
    start = snapshots.agg(F.min(time)).scalar()
    whole = Window.partitionBy(*KEYS)
    first_share = F.max(F.when(F.col(time) == F.col("start"), F.col("value"))).over(whole)
    compared = (
        smoothed.withColumn("start", start)
        .withColumn(
            "previous",
            F.when(F.col("family") == "share", F.coalesce(first_share, F.lit(0.0))).otherwise(
                F.lag("baseline").over(per_key)
            ),
        )
        .where((F.col(time) > F.col("start")) & F.col("previous").isNotNull())
        .select(time, *KEYS, F.col("previous").alias("baseline"), F.col("value").alias("current"))
    )
    return _drifts(compared, (time,))


def drift_summary(drifts: DataFrame, by: Sequence[str] = WINDOW) -> DataFrame:
    """Number of drifts and worst severity per drift type; severities are ranked, not spelled."""
    pairs = [F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)]
    rank = F.create_map(*pairs)[F.col("severity")]
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return drifts.groupBy(*by, "type").agg(
        F.count(F.lit(1)).alias("n_drifts"), names[F.max(rank)].alias("severity")
    )


def drift_alerts(summary: DataFrame, by: Sequence[str] = WINDOW) -> DataFrame:
    """Alert for every drift type that is high or critical."""
    label = F.when(F.col("type") == "fairness_drift", "Fairness").otherwise("Statistical")
    message = F.format_string(
        ALERT_MESSAGE, F.col("type"), label, F.col("n_drifts")
    )
    return summary.where(F.col("severity").isin("high", "critical")).select(
        *by, F.lit("DRIFT_DETECTED").alias("type"), "severity", message.alias("message"), F.col("type").alias("drift")
    )


def _recent(alerts: DataFrame, days: int, time: str, until) -> DataFrame:
    end = alerts.agg(F.max(time)).scalar() if until is None else F.lit(until).cast("timestamp")
    return alerts.where((F.col(time) > end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(time) <= end))


def monitoring_report(
    alerts: DataFrame, days: int = 7, time: str = "window_start", until=None
) -> DataFrame:
    """Alert counts of the last ``days`` days before ``until`` (default: the latest alert)."""
    return _recent(alerts, days, time, until).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("type") == "DRIFT_DETECTED").alias("drifts_detected"),
        F.count_if(F.col("type") == "PERFORMANCE_DEGRADATION").alias("performance_issues"),
    )


def alert_counts(alerts: DataFrame, days: int = 7, time: str = "window_start", until=None) -> DataFrame:
    """The same period broken down by type and severity."""
    return _recent(alerts, days, time, until).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("alerts"))
