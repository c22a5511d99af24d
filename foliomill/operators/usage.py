"""Which pages show which documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("publish", "draft", "pending", "private", "future")


def json_texts(col: Column) -> Column:
    """All strings of a JSON text, whatever they are nested in, without their escapes; of a broken one, those that it has.

    Strings are cut out where they stand, so that no level has to be walked. An escape that JSON doesn't have is kept,
    but for quotes.
    """
    # Escaped backslashes and quotes are out of the way while strings are cut: the pattern needs no alternatives.
    aside = F.replace(F.replace(col, F.lit("\\\\"), F.lit("\u0003")), F.lit('\\"'), F.lit("\u0004"))
    back = lambda x: F.replace(F.replace(x, F.lit("\u0004"), F.lit('\\"')), F.lit("\u0003"), F.lit("\\\\"))
    quoted = F.transform(F.regexp_extract_all(aside, F.lit('"[^"]*"'), 0), back)
    read = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return F.when(F.size(read) == F.size(quoted), read).otherwise(F.transform(quoted, lambda x: F.replace(x, F.lit('\\"'), F.lit('"'))))


def references(hosts: DataFrame, reference: str) -> Column:
    """The references in a host's content and, where there is such a column, in the strings of its ``builder`` (JSON)."""
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(reference), 1)
    if "builder" not in hosts.columns:
        return F.array_distinct(found)
    # String by string: a reference doesn't run over the end of one.
    built = F.flatten(F.transform(json_texts(F.col("builder")), lambda x: F.regexp_extract_all(x, F.lit(reference), 1)))
    return F.array_distinct(F.concat(found, F.coalesce(built, F.array().cast("array<string>"))))


def usage_edges(hosts: DataFrame, docs: DataFrame, reference: str) -> DataFrame:
    """host_id, status and doc: distinct references of live hosts to existing documents; ``reference`` has one group."""
    found = hosts.filter(F.col("status").isin(*LIVE)).select("host_id", "status", F.explode(references(hosts, reference)).alias("doc"))
    return found.join(docs.select("doc").distinct(), "doc", "left_semi")


def hosts_of(edges: DataFrame, most: int = 100, shown: int = 5) -> DataFrame:
    """Per document its hosts, published first, ``most`` at most: the count, the first one, the first ``shown``, and how many more there are."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy((F.col("status") != "publish").cast("int"), "host_id"))
    ranked = edges.withColumn("rank", rank).filter(F.col("rank") <= most)
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "host_id"))))
    found = ranked.groupBy("doc").agg(F.count("*").alias("hosts"), F.min_by("host_id", "rank").alias("first_host"), F.transform(few, lambda x: x["host_id"]).alias("first_hosts"))
    return found.withColumn("more", F.greatest(F.col("hosts") - shown, F.lit(0)))


def orphans(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents that no published page shows."""
    return docs.join(edges.filter("status = 'publish'"), "doc", "left_anti")


def first_document_of(hosts: DataFrame, docs: DataFrame, reference: str) -> DataFrame:
    """The first existing document among a host's references, in text order."""
    found = hosts.select("host_id", F.posexplode(F.regexp_extract_all("content", F.lit(reference), 1)).alias("n", "doc"))
    return found.join(docs.select("doc").distinct(), "doc", "left_semi").groupBy("host_id").agg(F.min_by("doc", "n").alias("doc"))


def usage_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """References removed and added, both ways of the set difference."""
    keys = ["host_id", "doc"]
    removed, added = old.select(keys).subtract(new.select(keys)), new.select(keys).subtract(old.select(keys))
    return removed.withColumn("change", F.lit("removed")).unionByName(added.withColumn("change", F.lit("added")))
