"""Admission as streams: the sliding log as keyed state, counts of fixed windows, distinct keys within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_log_stream(requests: DataFrame, most: int, window: int) -> DataFrame:
    """(client, event_id, allowed) of a stream (client BIGINT, event_id BIGINT, epoch BIGINT, ts TIMESTAMP): the operator
    sliding_log with each client's log as state. Within a batch requests go by epoch and event_id; a request earlier
    than what the log has seen is judged where it comes. The state of a client without requests for a window is dropped
    once the watermark has passed."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["epoch", "event_id"])
        allowed = []
        for now in rows["epoch"].tolist():
            log = [t for t in log if t > now - window]
            allowed.append(len(log) < most)
            if allowed[-1]:
                log.append(now)
        state.update((log,))
        state.setTimeoutTimestamp(max(int(rows["epoch"].max()) + window, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame({"client": key[0], "event_id": rows["event_id"], "allowed": allowed})

    timed = requests.withWatermark("ts", f"{window} seconds")
    return timed.groupBy("client").applyInPandasWithState(judge, "client long, event_id long, allowed boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def coupled_windows_stream(requests: DataFrame, limit: int, daily_limit: int, window: int = 3600, day: int = 86400) -> DataFrame:
    """(day, event_id, allowed, scope) of a stream (client, event_id, epoch, ts): the operator coupled_windows.

    The shared counter makes a day one key. Its state is bounded by what it can admit: the admitted requests of each
    client's window, ``daily_limit`` at most in all. Within a batch requests go by epoch and event_id; a day's state is
    dropped once the watermark has passed its end."""
    if day % window:
        raise ValueError("the shared window must be a multiple of the client's")

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        admitted: dict[str, int] = dict(zip(*state.get)) if state.exists else {}
        total = sum(admitted.values())
        rows = pd.concat(list(frames)).sort_values(["epoch", "event_id"])
        allowed, scope = [], []
        for client, epoch in zip(rows["client"].tolist(), rows["epoch"].tolist()):
            slot = f"{client}/{epoch // window}"
            why = "client" if admitted.get(slot, 0) >= limit else "daily" if total >= daily_limit else None
            allowed.append(why is None)
            scope.append(why)
            if why is None:
                admitted[slot] = admitted.get(slot, 0) + 1
                total += 1
        state.update((list(admitted), list(admitted.values())))
        state.setTimeoutTimestamp(max((int(key[0]) + 1) * day, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame({"day": key[0], "event_id": rows["event_id"], "allowed": allowed, "scope": pd.Series(scope, index=rows.index, dtype=object)})

    timed = requests.withWatermark("ts", f"{window} seconds").withColumn("day", F.floor(F.col("epoch") / day))
    return timed.groupBy("day").applyInPandasWithState(judge, "day long, event_id long, allowed boolean, scope string", "slots array<string>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def window_counts_stream(requests: DataFrame, window: int, late: str = "1 hour") -> DataFrame:
    """(client, bucket, n) of windows that are over: requests later than ``late`` are left out, and so is the state."""
    timed = requests.withWatermark("ts", late).groupBy("client", F.window("ts", f"{window} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return timed.select("client", F.floor(F.unix_seconds("window.start") / window).alias("bucket"), "n")


def first_seen_stream(rows: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
