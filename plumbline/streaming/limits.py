"""A rate limit as keyed state: each request of a stream is allowed or denied when it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests of a key that are allowed in any so many seconds.
HITS, SECONDS = 10, 60.0


def decide(past: list[int], now: int, hits: int, window: int) -> tuple[bool, list[int]]:
    """Whether a request is allowed, and the allowed ones that later ones have to count: those less than a window old, ``hits`` at most."""
    recent = [t for t in past if t > now - window]
    return (True, [*recent, now]) if len(recent) < hits else (False, recent)


def decisions(stream: DataFrame, key: str, time: str, row_id: str, hits: int = HITS, seconds: float = SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, row_id, time, allowed) of each request of a stream; denied ones do not count against later ones.

    Requests of a micro-batch are decided in order of time and then row_id, and
    after those of earlier batches. A key's state is the times of its last
    allowed requests, ``hits`` at most, and goes once the watermark is a window
    past the last. Requests more than ``late`` behind the latest get no decision;
    Spark counts them as dropped. Null keys are one key; a null time is denied.
    A task holds what one key has in one micro-batch.
    """
    window = int(seconds * 1_000_000)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(row_id).alias("row_id"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)

    def each(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        d = pd.concat(list(batches)).sort_values(["time", "row_id"], na_position="first")
        allowed = []
        for t in d["time"]:
            ok = False
            if not pd.isna(t):
                ok, past = decide(past, t.value // 1000, hits, window)
            allowed.append(ok)
        if past:
            state.update((past,))
            state.setTimeoutTimestamp(max(past[-1] // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs()) + 1)
        yield d.assign(allowed=allowed)[["key", "row_id", "time", "allowed"]]

    id_type = rows.schema["row_id"].dataType.simpleString()
    out = rows.groupBy("key").applyInPandasWithState(each, f"key string, row_id {id_type}, time timestamp, allowed boolean", "past array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.col("row_id").alias(row_id), F.col("time").alias(time), "allowed")
