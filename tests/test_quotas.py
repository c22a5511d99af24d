import random

import pandas as pd

from foliomill.streaming import quotas


def brute(rows, most, seconds):
    out, state = [], {}
    for reader, event, ts in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        count, last = state.get(reader, (0, None))
        if last is None or (ts - last).total_seconds() >= seconds:
            count = 0
        if count < most:
            state[reader] = (count + 1, ts)
        out.append((reader, event, count < most))
    return sorted(out, key=repr)


def test_quota_carries_a_hot_reader_over_batches(spark):
    r = random.Random(5)
    times = [pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=r.choice([r.randrange(4000), r.randrange(40_000)])) for _ in range(3000)]
    rows = [(r.choice([1, 1, 1, 2, 3, None]), i, t.to_pydatetime()) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "reader long, event_id long, ts timestamp")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        for most, seconds in ((20, 3600), (3, 60), (1, 1)):
            got = quotas.quota(events, most, seconds)
            assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # a whole reader in one frame
            assert sorted(((x.reader, x.event_id, x.accepted) for x in got.collect()), key=repr) == brute(rows, most, seconds)
    finally:
        spark.conf.set(key, before)


def test_one_reader_runs_in_many_tasks(spark):
    start = pd.Timestamp("2026-01-01")
    rows = [(1, i, (start + pd.Timedelta(minutes=i // 5 * 90, seconds=i % 5)).to_pydatetime()) for i in range(500)]
    events = spark.createDataFrame(rows, "reader long, event_id long, ts timestamp")
    cut = quotas.sessions(events, 3600)
    assert cut.select("session").distinct().count() == 100
    assert max(r["count"] for r in cut.repartition(8, "reader", "session").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()) < 200
    assert [x.accepted for x in quotas.quota(events, 3, 3600).orderBy("event_id").collect()] == [True, True, True, False, False] * 100


def test_events_without_a_time_belong_to_the_last_session(spark):
    start = pd.Timestamp("2026-01-01").to_pydatetime()
    events = spark.createDataFrame([(1, 1, start), (1, 2, None), (1, 3, None), (2, 4, None)], "reader long, event_id long, ts timestamp")
    assert [x.accepted for x in quotas.quota(events, 2, 60).orderBy("event_id").collect()] == [True, True, False, True]
    assert quotas.quota(events.filter("false"), 2, 60).count() == 0
