"""Job states, stage changes and event counts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def latest_states(jobs: DataFrame) -> DataFrame:
    """Latest status of each job; ties to the greatest id. For update or complete mode."""
    return jobs.groupBy("job_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), F.max("created_at").alias("created_at"))


def counts_by_window(events: DataFrame, key: str, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in windows of event time; a window is final once the watermark has passed it."""
    return event_time(events, at).withWatermark(at, late).groupBy(F.window(at, width).alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def stage_changes(history: DataFrame) -> DataFrame:
    """(lead_id, id, at_us, stage) -> (lead_id, id, at_us, from_stage, to_stage) wherever a lead's stage differs from the one before.

    The stage a lead is in never goes stale, so its state, one word, stays as long
    as the lead. Within a micro-batch a lead's stages go in order of time, between
    micro-batches in order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at_us", "id"], kind="stable")
        out = []
        for r in rows.itertuples():
            if before is not None and before != r.stage:
                out.append((r.lead_id, r.id, r.at_us, before, r.stage))
            before = r.stage
        state.update((before,))
        yield pd.DataFrame(out, columns=["lead_id", "id", "at_us", "from_stage", "to_stage"])

    return history.groupBy("lead_id").applyInPandasWithState(
        step, "lead_id long, id long, at_us long, from_stage string, to_stage string", "stage string", "append", GroupStateTimeout.NoTimeout
    )
