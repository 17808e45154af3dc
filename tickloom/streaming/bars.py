"""Bars and exponential means of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _decayed(x: np.ndarray, start: float, q: float) -> np.ndarray:
    """The sums s of s = q * s + x, from start on: prefix sums of scaled values, over stretches short enough not to overflow."""
    size = 1 if q < 1e-3 else max(1, min(len(x), int(200 / -np.log10(q))))
    out, s = np.empty(len(x)), start
    for lo in range(0, len(x), size):
        part = x[lo : lo + size]
        power = q ** np.arange(len(part))
        out[lo : lo + size] = power * (q * s + np.cumsum(part / power))
        s = out[lo + len(part) - 1]
    return out


def streaming_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(symbol, dt, open, high, low, close, volume) of a stream of events(event_id, ts, event_type, value), in windows of event
    time, which overlap if slide is less than width. Events later than the watermark are dropped; a bar comes out once the watermark has passed it.
    Of a table, all bars."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = timed.groupBy(F.window("ts", width, slide), "event_type").agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return made.select(F.col("event_type").alias("symbol"), F.col("window.start").alias("dt"), "open", "high", "low", "close", "volume")


def streaming_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, started, ended, n_events, highest, value) of a stream of events(ts, user_id, value): a user's events that follow one another
    by less than gap are a session, which ends a gap after its last event. Sessions merge as events arrive; one comes out once the watermark has
    passed its end. Events later than the watermark are dropped. Events without a time or user have no session. Of a table, all sessions."""
    known = events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull())
    timed = known.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = timed.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(
        F.count("*").alias("n_events"), F.max("value").alias("highest"), F.sum("value").alias("value")
    )
    return made.select("user_id", F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "n_events", "highest", "value")


def streaming_ewm(bars: DataFrame, span: float, late: str = "10 minutes") -> DataFrame:
    """(symbol, dt, close, ewm) of a stream of bars(symbol, dt, close): two numbers of state for each symbol, the mean's
    numerator and denominator. A batch's bars are taken in the order of dt; a bar older than one
    already taken in is left out, as the mean can't be mended behind it."""
    q = 1 - 2 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, bottom, last = state.get if state.exists else (0.0, 0.0, float("-inf"))
        rows = pd.concat(list(frames)).dropna(subset=["close"]).sort_values("dt", ignore_index=True).drop_duplicates("dt")
        at = rows["dt"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9 if len(rows) else np.zeros(0)
        rows = rows[at > last]
        if len(rows):
            last = float(at.max())
            tops, bottoms = (_decayed(x, start, q) for x, start in ((rows["close"].to_numpy(float), top), (np.ones(len(rows)), bottom)))
            top, bottom = float(tops[-1]), float(bottoms[-1])
            rows = rows.assign(symbol=key[0], ewm=tops / bottoms)
        state.update((top, bottom, last))
        yield rows.reindex(columns=["symbol", "dt", "close", "ewm"])

    timed = bars.select("symbol", "dt", "close").withWatermark("dt", late)
    return timed.groupBy("symbol").applyInPandasWithState(step, "symbol string, dt timestamp, close double, ewm double", "top double, bottom double, last double", "append", GroupStateTimeout.NoTimeout)
