"""The rate limiter on a stream of calls, with its state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.rate_limit import Limiter


def limited_stream(calls: DataFrame, limit: int, window_us: int, late: str = "10 minutes") -> DataFrame:
    """(key string, id long, at_us long) -> the same with ``allowed``.

    Within a micro-batch calls of a key go in order of time, so what is held is a
    key's calls of one micro-batch, which the source's rate limits. Between micro-batches
    they go in order of arrival: a call that comes later than one after it is judged by
    the window then open, where the batch form would put it first. A key's state is two
    numbers; it goes once the watermark, ``late`` behind the newest call, has passed
    the end of its window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Limiter(*state.get) if state.exists else Limiter()
        rows = pd.concat([b[["key", "id", "at_us"]] for b in batches]).sort_values(["at_us", "id"], kind="stable")
        allowed = [own.call(int(t), limit, window_us) for t in rows["at_us"]]
        state.update((own.count, own.ends))
        state.setTimeoutTimestamp(max(own.ends // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=allowed)

    timed = calls.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(step, "key string, id long, at_us long, allowed boolean", "count long, ends long", "append", GroupStateTimeout.EventTimeTimeout)
