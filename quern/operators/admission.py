"""Admission of requests: two coupled fixed windows, and a sliding log. Batch forms; the streaming ones are in streaming/."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import seconds_until_reset
from quern.sources.tables import broadcast_if_bounded, pandas_mapped


def coupled_windows(requests: DataFrame, limit: int, daily_limit: int, window: int = 3600, day: int = 86400) -> DataFrame:
    """(event_id, allowed, scope, retry_after): each request against its client's window and the window all share.

    ``requests``: (event_id, client, epoch). Both counters are charged only for admitted requests. Exact as windows
    where ``day`` is a multiple of ``window``, which is checked: then a client's window lies within one shared window.
    """
    if day % window:
        raise ValueError("the shared window must be a multiple of the client's")
    buckets = requests.withColumns({"__c": F.floor(F.col("epoch") / window), "__d": F.floor(F.col("epoch") / day)})
    by_client = Window.partitionBy("client", "__c").orderBy("epoch", "event_id")
    ranked = buckets.withColumn("__rn", F.row_number().over(by_client))
    # The shared window admits its first candidates, so each needs no more than the place of the last of them: the limit
    # goes below the shuffle and no task sees a whole day.
    by_day = Window.partitionBy("__d").orderBy("epoch", "event_id")
    first = ranked.where(F.col("__rn") <= limit).withColumn("__p", F.row_number().over(by_day)).where(F.col("__p") <= daily_limit)
    last = broadcast_if_bounded(first.groupBy("__d").agg(F.max(F.struct("epoch", "event_id")).alias("__last")))
    ok = (F.col("__rn") <= limit) & F.coalesce(F.struct("epoch", "event_id") <= F.col("__last"), F.lit(False))
    both = ranked.join(last, "__d", "left").withColumn("__ok", ok)
    before = F.coalesce(F.sum(F.col("__ok").cast("int")).over(by_client.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scope = F.when(~F.col("__ok"), F.when(F.col("__before") >= limit, "client").otherwise("daily"))
    wait = F.when(scope == "client", seconds_until_reset(F.col("epoch"), window)).when(scope == "daily", seconds_until_reset(F.col("epoch"), day)).otherwise(0)
    return both.withColumn("__before", before).select("event_id", F.col("__ok").alias("allowed"), scope.alias("scope"), wait.cast("bigint").alias("retry_after"))


def idle_stretches(requests: DataFrame, window: int) -> DataFrame:
    """``requests`` with (__b, __s): the bucket of ``window`` seconds and the stretch it belongs to. After a bucket without a
    request of its client, the log of a sliding window is empty, so stretches are independent of each other.

    Only buckets are sorted by client, not requests: they are made distinct before the shuffle."""
    placed = requests.withColumn("__b", F.floor(F.col("epoch") / window))
    by_client = Window.partitionBy("client").orderBy("__b")
    used = placed.select("client", "__b").distinct().withColumn("__new", (~F.lag("__b").over(by_client).eqNullSafe(F.col("__b") - 1)).cast("int"))
    stretches = used.select("client", "__b", F.sum("__new").over(by_client.rowsBetween(Window.unboundedPreceding, 0)).alias("__s"))
    return placed.join(stretches, ["client", "__b"])


def sliding_log(requests: DataFrame, most: int, window: int) -> DataFrame:
    """(event_id, allowed): at most ``most`` admitted requests of a client in any ``window`` seconds up to now.

    Refused requests do not count, which no frame of a window can say, so it is a fold: over requests sorted by stretch
    (see idle_stretches), one after the other, with a log of at most ``most`` times. A client that makes a third of all
    requests is as many stretches as it has idle buckets; one that never pauses is one stretch, which is sorted, not
    collected. Requests with a null client take no part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, log = None, deque()
        for frame in frames:
            allowed = []
            for client, s, now in zip(frame["client"].tolist(), frame["__s"].tolist(), frame["epoch"].tolist()):
                if (client, s) != stretch:
                    stretch, log = (client, s), deque()
                while log and log[0] <= now - window:
                    log.popleft()
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(now)
            yield pd.DataFrame({"event_id": frame["event_id"], "allowed": pd.Series(allowed, index=frame.index, dtype=bool)})

    rows = idle_stretches(requests.select("event_id", "client", "epoch").where(F.col("client").isNotNull()), window)
    sorted_rows = rows.repartition("client", "__s").sortWithinPartitions("client", "__s", "epoch", "event_id")
    return pandas_mapped(sorted_rows, run, f"event_id {requests.schema['event_id'].dataType.simpleString()}, allowed boolean")


def window_counts(requests: DataFrame, window: int) -> DataFrame:
    """(client, bucket, n): requests of each fixed window."""
    return requests.groupBy("client", F.floor(F.col("epoch") / window).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def counter_value(text: Column) -> Column:
    """A stored counter read defensively: what is absent, no whole number or not positive counts as 0."""
    return F.coalesce(F.greatest(F.try_to_number(F.when(text.rlike(r"^-?\d{1,18}$"), text), F.lit("S999999999999999999")).cast("bigint"), F.lit(0)), F.lit(0))
