"""Counters that run out some time after the last accepted event; batch and stream forms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHAPE = "reader long, event_id long, ts timestamp, accepted boolean"


def admit(times: pd.Series, count: int, last: pd.Timestamp | None, most: int, seconds: int) -> tuple[list[bool], int, pd.Timestamp | None]:
    """Accepts events in order: a counter of ``most`` that starts anew ``seconds`` after the last accepted one; refused ones change nothing."""
    out, gap = [], pd.Timedelta(seconds=seconds)
    for t in times:
        if last is None or t - last >= gap:
            count = 0
        good = count < most
        if good:
            count, last = count + 1, t
        out.append(good)
    return out, count, last


def _admitted(most: int, seconds: int):
    """Rows (reader, session, event_id, ts) in order of reader, session, ts and event_id to SHAPE; between batches only the last session's counter is carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, last = (), 0, None  # no session is ()
        for batch in batches:
            times, accepted = batch.column(3).to_pandas(), []
            for session, same in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if session != known:
                    known, count, last = session, 0, None
                at = len(accepted)
                good, count, last = admit(times[at : at + sum(1 for _ in same)], count, last, most, seconds)
                accepted += good
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(accepted, pa.bool_())], ["reader", "event_id", "ts", "accepted"])

    return run


def sessions(events: DataFrame, seconds: int) -> DataFrame:
    """Events (reader, event_id, ts) with ``session``: a reader's events without a pause of ``seconds`` have one number.

    Time is cut into cells of ``seconds``. Within a cell no pause is that long, so that a session only begins with the
    first event of a cell, and cells, not events, are put in order. Events without a time belong to the last session.
    """
    rows = events.withColumn("cell", F.floor(F.unix_micros("ts") / (seconds * 1_000_000)))
    cells = rows.groupBy("reader", "cell").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    of = Window.partitionBy("reader").orderBy(F.asc_nulls_last("cell"))
    pause = F.unix_micros("low") - F.unix_micros(F.lag("high").over(of)) >= seconds * 1_000_000
    starts = cells.withColumn("opens", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("session", F.sum("opens").over(of))
    named = starts.select(F.col("reader").alias("_reader"), F.col("cell").alias("_cell"), "session")
    return rows.join(named, F.col("reader").eqNullSafe(F.col("_reader")) & F.col("cell").eqNullSafe(F.col("_cell"))).select("reader", "session", "event_id", "ts")


def quota(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Events (reader, ts, event_id) with ``accepted``.

    A pause of ``seconds`` starts the counter anew whatever came before, so that sessions are judged apart, a reader's
    in many tasks; Spark sorts them, and no session has to fit into a worker.
    """
    rows = events.select(F.col("reader").cast("long").alias("reader"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    ordered = sessions(rows, seconds).repartition("reader", "session").sortWithinPartitions("reader", "session", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return ordered.mapInArrow(_admitted(most, seconds), SHAPE)


def stream_quota(events: DataFrame, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream; a reader's state goes when the counter has run out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = None if last is None else pd.Timestamp(last, unit="us")
        accepted, count, last = admit(rows["ts"], count, last, most, seconds)
        state.update((count, None if last is None else last.value // 1000))
        if last is not None:
            state.setTimeoutTimestamp(max(last.value // 1_000_000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(accepted=accepted)[["reader", "event_id", "ts", "accepted"]]

    rows = events.select("reader", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("reader").applyInPandasWithState(run, SHAPE, "count int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def daily_cap(events: DataFrame, most: int = 300) -> DataFrame:
    """The first ``most`` events of each UTC day; a task keeps no more than that before the days meet."""
    day = F.to_date("ts")
    rows = events.withColumn("day", day).withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    part = F.row_number().over(Window.partitionBy("day", "_salt").orderBy("ts", "event_id"))
    few = rows.withColumn("_r", part).filter(F.col("_r") <= most)
    whole = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    return few.withColumn("_n", whole).filter(F.col("_n") <= most).select("event_id", "day")
