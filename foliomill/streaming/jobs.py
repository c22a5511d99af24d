"""Jobs that fell silent, over a stream of their steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHAPE = "job_id long, last_page long, silent_since timestamp"
STATE = "ts long, event_id long, ended boolean, page long, lock long"


def stream_abandoned(steps: DataFrame, seconds: int = 600, late: str = "10 minutes", end: str = "done") -> DataFrame:
    """job_id, last_page and silent_since of jobs whose latest step is no end, once ``seconds`` have gone by without another.

    ``steps``: job_id, ts, event_id, status, page and lock_until, a time until which a worker has the job for itself
    (null: none); a job isn't abandoned under a lock. Time is the watermark, ``late`` behind the latest step. Steps may
    come in any order within it: the latest by ts and event_id counts. A job is named once; a step that comes after
    that begins its wait anew. An ended job is remembered for ``seconds``, so that an older step that comes late
    doesn't open it again. Steps without a time play no part.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if known and not known[2]:
                yield pd.DataFrame({"job_id": [key[0]], "last_page": pd.array([known[3]], "Int64"), "silent_since": pd.to_datetime([known[0]], unit="us")})
            return
        for rows in batches:
            for ts, event_id, status, page, lock in zip(rows["micros"], rows["event_id"], rows["status"], rows["page"], rows["lock"]):
                held = max(int(lock) if pd.notna(lock) else 0, known[4] if known else 0)
                own = (int(ts), int(event_id), status == end, None if pd.isna(page) else int(page), held)
                known = own if known is None or own[:2] >= tuple(known[:2]) else (*known[:4], held)
        state.update(known)
        state.setTimeoutTimestamp(max(known[0] // 1000 + seconds * 1000, known[4] // 1000, state.getCurrentWatermarkMs() + 1))

    rows = steps.select("job_id", "ts", F.unix_micros("ts").alias("micros"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), "status", F.col("page").cast("long").alias("page"), F.unix_micros("lock_until").alias("lock"))
    timed = rows.filter("ts is not null").withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(run, SHAPE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
