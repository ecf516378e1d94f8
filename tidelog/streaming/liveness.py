"""Liveness as a stream: changes between alive and offline, per broker, by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.config import BrokerSettings


def liveness_changes(heartbeats: DataFrame, settings: BrokerSettings, delay: str = "10 seconds") -> DataFrame:
    """(broker_id, at_ms, is_alive): a broker's first heartbeat, its time-outs and its returns.

    A broker is alive until no heartbeat has come for longer than the interval times the misses allowed; any heartbeat
    revives it. Time is that of the heartbeats, with a watermark of ``delay``; heartbeats without a timestamp carry none.
    """
    silence = settings.heartbeat_interval_ms * settings.missed_heartbeats

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alive = state.get if state.exists else (-1, False)
        out: list[tuple[int, bool]] = []
        if state.hasTimedOut:
            out.append((last + silence + 1, False))
            alive = False
        else:
            for t in sorted(int(x) for f in frames for x in f["timestamp_ms"]):
                if alive and t - last > silence:
                    out.append((last + silence + 1, False))
                    alive = False
                if not alive and t > last:
                    out.append((t, True))
                    alive = True
                last = max(last, t)
        state.update((last, alive))
        if alive:
            state.setTimeoutTimestamp(max(last + silence + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"broker_id": [key[0]] * len(out), "at_ms": [t for t, _ in out], "is_alive": [a for _, a in out]})

    timed = heartbeats.where(F.col("timestamp_ms").isNotNull()).withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)
    return timed.groupBy("broker_id").applyInPandasWithState(
        run, "broker_id string, at_ms long, is_alive boolean", "last long, alive boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
