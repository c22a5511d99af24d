"""The streams give what the batch forms give, also after a restart."""

import datetime

import pytest

from foliomill.operators.usage import usage_edges
from foliomill.streaming import jobs, quotas, tables

START = datetime.datetime(2026, 1, 1)
LOG = "id long, ts timestamp, level string, event string, message string, context string"


def test_log_goes_on_after_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.createDataFrame([(i, START, "odd", "A.B", " <b>x</b>  y ", '{"k": "1", "token": "t"}')], LOG).write.mode("append").parquet(source)
        tables.stream_log(spark.readStream.schema(LOG).parquet(source), out, str(tmp_path / "check")).awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
        assert got == [(k, START, "info", "a_b", "x y", {"k": "1"}) for k in range(i + 1)]


def test_usage_follows_the_latest_save(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([("17",), ("179",)], "doc string")
    shape = "host_id long, status string, content string"
    for rows in ([(1, "publish", 'href="17" href="179"'), (2, "draft", 'href="17"')], [(1, "publish", 'href="179"')], [(2, "trash", 'href="17"')]):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(source)
        tables.stream_usage(spark.readStream.schema(shape).parquet(source), docs, r'href="([^"]+)"', out, str(tmp_path / "check")).awaitTermination(120)
    got = sorted((r.doc, r.host_id) for r in tables.current_edges(spark.read.parquet(out)).select("doc", "host_id").collect())
    last = spark.createDataFrame([(1, "publish", 'href="179"'), (2, "trash", 'href="17"')], shape)
    assert got == sorted((r.doc, r.host_id) for r in usage_edges(last, docs, r'href="([^"]+)"').collect()) == [("179", 1)]


@pytest.mark.parametrize(("most", "seconds"), [(2, 60), (1, 5)])
def test_quota_as_in_the_batch(spark, tmp_path, most, seconds):
    shape = "reader long, event_id long, ts timestamp"
    rows = [(n % 2, n, START + datetime.timedelta(seconds=n * n % 97 + n * 7)) for n in range(40)]
    rows.sort(key=lambda r: r[2])
    source = str(tmp_path / "in")
    name = f"quota_{most}"
    for low in (0, 20):  # two batches, the later events in the later one
        spark.createDataFrame(rows[low : low + 20], shape).coalesce(1).write.mode("append").parquet(source)
        stream = quotas.stream_quota(spark.readStream.schema(shape).parquet(source), most, seconds)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.event_id, r.accepted) for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert got == sorted((r.event_id, r.accepted) for r in quotas.quota(spark.createDataFrame(rows, shape), most, seconds).collect())


def test_many_batches_leave_few_folders(spark, tmp_path):
    out, shape, reference = str(tmp_path / "out"), "host_id long, status string, content string", r'href="([^"]+)"'
    docs = spark.createDataFrame([(str(i),) for i in range(5)], "doc string").coalesce(1)
    want, seen = {}, []
    for n in range(24):
        rows = [(n % 7, "trash" if n % 5 == 4 else "publish", f'href="{n % 5}" href="{(n + 1) % 6}"'), (100 + n, "draft", 'href="1"')]
        batch = spark.createDataFrame(rows, shape).coalesce(1)
        tables.save_edges(batch, n, docs, reference, out, 4)
        if n in (4, 13, 20):  # a batch is repeated after a failure, with and without a merge behind it
            tables.save_edges(batch, n, docs, reference, out, 4)
        for host, status, content in rows:
            want[host] = set() if status == "trash" else {d for d in content.split('"')[1::2] if int(d) < 5}
        seen.append(len([x for x in (tmp_path / "out").iterdir() if x.name.startswith("batch=")]))
        assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_merge")]
    assert max(seen) <= 5
    got = {(r.host_id, r.doc) for r in tables.current_edges(spark.read.parquet(out)).collect()}
    assert got == {(h, d) for h, ds in want.items() for d in ds}


def test_jobs_that_fall_silent(spark, tmp_path):
    shape = "job_id long, ts timestamp, event_id long, status string, page int, lock_until timestamp"
    at = lambda s: START + datetime.timedelta(seconds=s)
    batches = [
        [(1, at(0), 1, "step", 3, None), (2, at(0), 2, "step", 1, None), (3, at(0), 3, "step", 5, at(3_000)), (4, at(10), 4, "step", 7, None), (7, None, 9, "step", 1, None)],
        # A late step of 4 that is older than the one known, the end of 2, and a step before it that comes after.
        [(4, at(5), 5, "step", 6, None), (2, at(20), 6, "done", 9, None), (5, at(900), 7, "step", 2, None)],
        [(2, at(15), 8, "step", 8, None), (5, at(1_100), 9, "step", 4, None), (6, at(2_000), 10, "step", 1, None)],
        [(6, at(2_600), 11, "done", 2, None), (9, at(9_000), 12, "done", 1, None)],
        [(9, at(9_001), 13, "done", 1, None)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    named = []
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_abandoned(spark.readStream.schema(shape).parquet(source), 600, "100 seconds")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        named.append(sorted((r.job_id, r.last_page, r.silent_since) for r in spark.read.schema(jobs.SHAPE).parquet(out).collect()))
    assert named[0] == []
    assert named[-1] == [(1, 3, at(0)), (3, 5, at(0)), (4, 7, at(10)), (5, 4, at(1_100))]
    assert (3, 5, at(0)) not in named[2]  # still under its lock
