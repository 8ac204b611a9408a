"""Smoothed baselines that live in the stream's state store.

One state per snapshot key holds its baseline and the values whose window may still be followed by an earlier one.
Event-time timers fold values into the baseline in the order of their windows, whatever order they arrive in, once
the watermark has passed them. The state survives restarts with the stream's checkpoint, can begin from a stored
baseline, and forgets keys that stay away for long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evenhand.operators.drift import KEYS, SMOOTHING, _drifts
from evenhand.streaming.monitor import drain_append

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Smoother(StatefulProcessor):
    """State of one key: its baseline with the window it reaches to, and values waiting for the watermark."""

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.baseline = handle.getValueState("baseline", "value double, reaches long")
        self.waiting = handle.getMapState("waiting", "at long", "value double, alpha double, fill double")

    def handleInitialState(self, key, initial, timerValues) -> None:
        last = initial.sort_values("reaches").iloc[-1]
        self._keep(float(last["baseline"]), int(last["reaches"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reaches = self.baseline.get()[1] if self.baseline.exists() else None
        for batch in rows:
            for at, value, alpha, fill in zip(batch["at"], batch["value"], batch["alpha"], batch["fill"], strict=True):
                at = int(at)
                if reaches is not None and at <= reaches:
                    continue  # already folded: the watermark had passed it
                if not self.waiting.containsKey((at,)):
                    self.handle.registerTimer(at)
                self.waiting.updateValue((at,), (float(value), float(alpha), None if pd.isna(fill) else float(fill)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        state = self.baseline.get() if self.baseline.exists() else None
        due = sorted((at[0], value) for at, value in self.waiting.iterator() if at[0] <= until)
        out = []
        for at, (value, alpha, fill) in due:
            previous = fill if state is None else state[0]
            state = (value if previous is None else alpha * value + (1.0 - alpha) * previous, at)
            out.append((*key, at, value, previous, state[0]))
            self.waiting.removeKey((at,))
        if due:
            self._keep(*state)
        elif state is not None and self.forget_ms is not None and state[1] + self.forget_ms <= until:
            self.baseline.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.keys(key), "at", "value", "previous", "baseline"])

    def _keep(self, value: float, reaches: int) -> None:
        self.baseline.update((value, reaches))
        if self.forget_ms is not None:
            self.handle.registerTimer(reaches + self.forget_ms)

    @staticmethod
    def keys(key: tuple) -> list[str]:
        return [f"key_{i}" for i in range(len(key))]

    def close(self) -> None:
        pass


def _millis(time: str) -> Column:
    return F.unix_millis(F.col(time).cast("timestamp"))


def smoothed_stream(
    snapshots: DataFrame,
    alpha: Column | float = SMOOTHING,
    fill: Column | float | None = None,
    delay: str = "30 days",
    initial: DataFrame | None = None,
    forget: str | None = None,
    time: str = "window_start",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Stream of (time, keys, value, previous, baseline): each value that the watermark has passed, with the key's baseline before and after it.

    b0 = x0, bt = alpha xt + (1 - alpha) b(t-1). ``alpha`` may differ by row; where a key has no baseline yet, ``fill`` counts as one
    if it is not null. A window's value may arrive up to ``delay`` behind the newest; the last delivery of a
    window counts, and windows up to ``delay`` before the newest have results. ``initial`` is a stored baseline (time, keys, baseline), whose keys begin there. A key that sends nothing for ``forget``
    begins anew. Values must not be null. The watermark is set here; run the result inside :func:`keyed_state`.
    """
    spark = snapshots.sparkSession
    names = [f"key_{i}" for i in range(len(keys))]
    prepared = snapshots.withWatermark(time, delay).select(
        time,
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        _millis(time).alias("at"),
        F.col("value").cast("double").alias("value"),
        (alpha if isinstance(alpha, Column) else F.lit(float(alpha))).cast("double").alias("alpha"),
        (fill if isinstance(fill, Column) else F.lit(fill)).cast("double").alias("fill"),
    )
    begun = None
    if initial is not None:
        begun = initial.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("baseline").cast("double").alias("baseline"), _millis(time).alias("reaches")
        ).groupBy(*names)
    forget_ms = None
    if forget is not None:
        forget_ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {forget})").first()[0]
    types = dict(snapshots.dtypes)
    schema = ", ".join([*(f"{n} {types[k]}" for k, n in zip(keys, names, strict=True)), "at long, value double, previous double, baseline double"])
    followed = prepared.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=Smoother(forget_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=begun
    )
    named = [F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]
    return followed.select(F.timestamp_millis("at").alias(time), *named, "value", "previous", "baseline")


def monitored(snapshots: DataFrame, initial: DataFrame, alpha: float = SMOOTHING, delay: str = "30 days", time: str = "window_start") -> DataFrame:
    """Stream of drifts of each window's snapshot against the baseline kept in state, which begins at the stored ``initial`` snapshot.

    As in :func:`evenhand.operators.drift.drift_vs_previous` group shares are not smoothed: they meet the initial ones, or 0 where a group was not there.
    """
    is_share = F.col("family") == "share"
    followed = smoothed_stream(
        snapshots,
        F.when(is_share, 0.0).otherwise(alpha),
        F.when(is_share, 0.0),
        delay,
        initial.withColumnRenamed("value", "baseline"),
        time=time,
    )
    compared = followed.where(F.col("previous").isNotNull()).select(
        time, *KEYS, F.col("previous").alias("baseline"), F.col("value").alias("current")
    )
    return _drifts(compared, (time,))


def drain_state(stream: DataFrame, folder: str) -> DataFrame:
    """Runs such a stream over everything available; returns what all runs so far have written."""
    with keyed_state(stream.sparkSession):
        return drain_append(stream, folder)
