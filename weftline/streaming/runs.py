"""The state of runs from their events: live from a stream, or of a whole table.

Events: run_id, event, step (null for events without one), ts. ``completed`` and ``failed`` end a
run; events without a run are left out. A run's state says how far its steps reach without a gap, so late steps close gaps and
repeated ones change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENDS = ("completed", "failed")
RUN = "run_id string, events long, steps long, contiguous long, highest long, missing long, latest_event string, latest_ts timestamp, status string, updates long"
#: events, updates, ranges of seen steps as "1-7,9-9", latest (ts in microseconds, step, event), end
STATE = "events long, updates long, ranges string, ts long, step long, event string, ended string"
NONE = -1


def add_steps(ranges: list[tuple[int, int]], steps: list[int]) -> list[tuple[int, int]]:
    """Ranges of steps, in order and apart from each other, with some more steps."""
    out: list[tuple[int, int]] = []
    for low, high in sorted([*ranges, *((s, s) for s in steps)]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _row(run: str, events: int, updates: int, ranges: list[tuple[int, int]], ts: int, event: str, status: str) -> pd.DataFrame:
    steps = sum(b - a + 1 for a, b in ranges)
    highest = ranges[-1][1] if ranges else 0
    contiguous = ranges[0][1] if ranges and ranges[0][0] == 1 else 0
    row = (run, events, steps, contiguous, highest, highest - steps, event, pd.Timestamp(ts, unit="us"), status, updates)
    return pd.DataFrame([row], columns=[c.split()[0] for c in RUN.split(", ")])


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    (run,) = key
    events, updates, text, ts, step, event, ended = state.get if state.exists else (0, 0, "", NONE, NONE, "", "")
    ranges = [tuple(map(int, r.split("-"))) for r in text.split(",") if r]
    if state.hasTimedOut:
        state.remove()
        yield _row(run, events, updates + 1, ranges, ts, event, ended or "timed_out")
        return
    for part in parts:
        steps = part["step"].dropna().astype("int64")
        ranges = add_steps(ranges, steps[steps > 0].unique().tolist())
        events += len(part)
        at = part["ts"].astype("datetime64[us]").astype("int64")
        order = sorted(zip(at, part["step"].fillna(NONE).astype("int64"), part["event"], strict=True))
        if order[-1] > (ts, step, event):
            ts, step, event = order[-1]
        ended = max([ended, *(e for e in part["event"] if e in ENDS)])  # a failure counts, whatever else came
    state.update((int(events), int(updates + 1), ",".join(f"{a}-{b}" for a, b in ranges), int(ts), int(step), event, ended))
    state.setTimeoutTimestamp(max(ts // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
    yield _row(run, events, updates + 1, ranges, ts, event, ended or "running")


def live_runs(events: DataFrame, late: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """The state of each run whenever events of it come (update mode): the row with most updates is the last.

    Events that come again within the watermark count once. A run that is silent for idle_seconds
    of event time is reported as ``timed_out`` (or as it ended), and its state goes. What is kept
    of a run are ranges of steps, so it is short unless many steps are missing.
    """
    once = events.where("run_id is not null").select("run_id", "event", F.col("step").cast("long").alias("step"), "ts").withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark(["run_id", "event", "step"])
    return once.groupBy("run_id").applyInPandasWithState(
        partial(_advance, idle_ms=idle_seconds * 1000), RUN, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def run_states(events: DataFrame) -> DataFrame:
    """The same of a whole table, without timeouts: a row for each run (no updates)."""
    once = events.where("run_id is not null").select("run_id", "event", F.col("step").cast("long").alias("step"), "ts").groupBy("run_id", "event", "step").agg(F.min("ts").alias("ts"))
    real = F.when(F.col("step") > 0, F.col("step"))
    step = once.groupBy("run_id", real.alias("step")).agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("step"))
    reach = step.where("step is not null").withColumn("ok", place == F.col("step")).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("ok").alias("contiguous"), F.max("step").alias("highest")
    )
    latest = F.struct("ts", F.coalesce("step", F.lit(NONE)).alias("step"), "event")
    ended = F.max(F.when(F.col("event").isin(*ENDS), F.col("event")))
    whole = once.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max(latest).alias("last"), F.coalesce(ended, F.lit("running")).alias("status"))
    joined = whole.join(reach, "run_id", "left").fillna(0, ["steps", "contiguous", "highest"])
    return joined.select(
        "run_id", "events", "steps", "contiguous", "highest", (F.col("highest") - F.col("steps")).alias("missing"), F.col("last.event").alias("latest_event"),
        F.col("last.ts").alias("latest_ts"), "status",
    )
