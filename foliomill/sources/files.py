"""Text files in, document tables and log exports out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliomill.operators.operations import export_rows


@F.pandas_udf(StringType())
def _legacy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace"))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files: UTF-8, else Windows-1252; no byte order mark; line feeds only."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(_legacy("content"))
    return files.select("path", F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n").alias("text"))


def write_documents(docs: DataFrame, path: str) -> None:
    """The final document table, by language."""
    docs.write.mode("overwrite").partitionBy("language").parquet(path)


def export_log_csv(log: DataFrame, path: str) -> None:
    """A log as CSV with a header."""
    export_rows(log).write.mode("overwrite").csv(path, header=True)


def refuse_empty(docs: DataFrame, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """(documents with words, the others); a null count is none."""
    n = F.coalesce(F.col(words), F.lit(0))
    return docs.filter(n > 0), docs.filter(n <= 0)


__all__ = ["export_log_csv", "read_text_corpus", "refuse_empty", "write_documents"]
