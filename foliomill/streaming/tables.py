"""Streams of log entries and of page changes into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.operations import normalize_log
from foliomill.operators.usage import usage_edges


def stream_log(raw: DataFrame, path: str, checkpoint: str):
    """Appends normalised entries; a restart goes on where the last one stopped."""
    return normalize_log(raw).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(batch: DataFrame, path: str):
    """The file system of a path, its Path class, and the numbers of the batches that have a folder there."""
    jvm, conf = batch.sparkSession.sparkContext._jvm, batch.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return files, jvm.org.apache.hadoop.fs.Path, sorted(float(x.removeprefix("batch=")) for x in names if x.startswith("batch="))


def save_edges(batch: DataFrame, number: int, docs: DataFrame, reference: str, path: str, most: int = 16) -> None:
    """Writes the edges of a batch of saved or removed hosts to a folder of its own, and merges folders when there are more than ``most``.

    A merge holds the current edges of all hosts. It is written aside, gets its name (between the numbers of this batch
    and the next) in one step, and only then older folders go, so that a reader finds every host at any time, and a
    batch that is repeated changes nothing: the merge behind it holds the same.
    """
    edges = usage_edges(batch, docs, reference)
    batch.select("host_id").distinct().join(edges, "host_id", "left").write.mode("overwrite").parquet(f"{path}/batch={number}")
    files, Path, numbers = _folders(batch, path)  # noqa: N806
    if len(numbers) <= most:
        return
    merged = current_edges(batch.sparkSession.read.parquet(path))
    aside, named = f"{path}/_merge-{number}", f"{path}/batch={number}.5"
    merged.write.mode("overwrite").parquet(aside)
    if files.exists(Path(named)):  # this batch is a repeated one
        files.delete(Path(aside), True)
    else:
        files.rename(Path(aside), Path(named))
    for old in numbers:
        if old <= number:
            files.delete(Path(f"{path}/batch={old:g}"), True)


def stream_usage(changes: DataFrame, docs: DataFrame, reference: str, path: str, checkpoint: str, most: int = 16):
    """Keeps the edges of each saved or removed host in at most ``most`` folders and one; see :func:`save_edges`."""

    def save(batch: DataFrame, number: int) -> None:
        save_edges(batch, number, docs, reference, path, most)

    return changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(stored: DataFrame) -> DataFrame:
    """Of the stored edges, those of each host's latest batch."""
    latest = stored.groupBy("host_id").agg(F.max("batch").alias("batch"))
    return stored.join(latest, ["host_id", "batch"], "left_semi").filter("doc is not null").drop("batch")
