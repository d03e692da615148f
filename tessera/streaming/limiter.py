"""The sliding-log rate limiter, in batch and as a stream, with one walk over a client's log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds without a request after which a client's log is dropped.
IDLE = 600.0
_OUT = "client bigint, event_id bigint, allowed boolean, retry_after double"


def walk(log: deque, times: Iterable[float], limit: int, window: float) -> Iterator[tuple[bool, float]]:
    """(allowed, retry after) of requests in order of time. ``log`` has the allowed ones inside the window, at
    most ``limit``, and is carried on: rejected requests aren't logged."""
    for t in times:
        while log and log[0] < t - window:
            log.popleft()
        if len(log) < limit:
            log.append(t)
            yield True, 0.0
        else:
            yield False, round(max(log[0] + window - t, 1.0), 3)


def sliding_log(requests: DataFrame, limit: int = 60, window_seconds: float = 60.0) -> DataFrame:
    """(client, event_id, allowed, retry_after) of requests (client, ts, event_id). A request is allowed
    while fewer than ``limit`` allowed ones lie in the window before it (its start included).

    Requests are sorted within partitions by client and time and walked in one pass, which holds a log of
    ``limit`` times and one batch, whatever the busiest client has."""
    own = requests.select("client", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    placed = own.repartition("client").sortWithinPartitions("client", "t", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log, begun = None, deque(), False
        for b in batches:
            allowed, wait = [], []
            for c, own in b.groupby((b["client"] != b["client"].shift()).cumsum(), sort=False):
                first = own["client"].iloc[0]
                if not begun or first != client:
                    client, log, begun = first, deque(), True
                for ok, seconds in walk(log, own["t"], limit, window_seconds):
                    allowed.append(ok)
                    wait.append(seconds)
            yield pd.DataFrame({"client": b["client"], "event_id": b["event_id"], "allowed": allowed, "retry_after": wait})

    return placed.mapInPandas(run, _OUT)


def limited_stream(requests: DataFrame, limit: int = 60, window_seconds: float = 60.0, idle_seconds: float = IDLE, late: str = "0 seconds") -> DataFrame:
    """T01, T02 on a stream with event times ``ts``: the same rows, in append mode. The state of a client is its
    log of at most ``limit`` times; it is dropped once the watermark is ``idle_seconds`` past its last request.
    Requests of a trigger are walked in order of time; those more than ``late`` behind the watermark are dropped
    by Spark, as the log that they belong to may be gone."""
    own = requests.select("client", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)

    def run(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = list(pieces)
        b = own[0] if len(own) == 1 else pd.concat(own)
        ids, times = b["event_id"].to_numpy(), b["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order].tolist()
        log = deque(state.get[0]) if state.exists else deque()
        found = list(walk(log, times, limit, window_seconds))
        state.update((list(log),))
        last = times[-1]
        state.setTimeoutTimestamp(max(int((last + idle_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": [key[0]] * len(ids), "event_id": ids, "allowed": [x for x, _ in found], "retry_after": [x for _, x in found]})

    return own.groupBy("client").applyInPandasWithState(run, _OUT, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
