"""HTML documents as trees: elements as intervals of token numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Elements without content, elements that may hold loose text, and inline elements.
VOID = "area base br col embed hr img input link meta source track wbr".split()
CONTAINERS = "div section article aside main blockquote li".split()
INLINE = "a abbr b bdi bdo br cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr font".split()
#: Elements whose start ends an open paragraph, and elements that a fragment doesn't keep.
ENDS_P = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()
WRAPPERS = "html body".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
_TOKEN = r"(?s)<!--.*?-->|<[sS][cC][rR][iI][pP][tT]\b.*?</[sS][cC][rR][iI][pP][tT]\s*>|<[sS][tT][yY][lL][eE]\b.*?</[sS][tT][yY][lL][eE]\s*>|</?[a-zA-Z][^>]*>|[^<]+|<"
#: Marks around text that stands in a list, table or other element that isn't searched for loose text.
SHELTER, OPEN_AIR = "\u0001", "\u0002"


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, final (the number of the last token), pos (from 0), token, tag, and way: 1 for a start, -1 for an end, else 0."""
    found = docs.select("doc_id", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_TOKEN), 0).alias("tokens"))
    rows = found.select("doc_id", (F.size("tokens") - 1).alias("final"), F.posexplode("tokens").alias("pos", "token"))
    rows = rows.withColumn("tag", F.when(F.col("token").rlike(r"(?i)^<(?:script|style)\b"), "").otherwise(F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))))
    alone = F.col("tag").isin(*VOID) | F.col("token").endswith("/>")
    return rows.withColumn("way", F.when((F.col("tag") == "") | alone, 0).when(F.col("token").startswith("</"), -1).otherwise(1))


def _stepped(rows: DataFrame) -> DataFrame:
    """Tags with their step, 1 for a start, -1 for an end that has one, else 0, and the level of their kind."""
    order = Window.partitionBy("doc_id", "tag").orderBy("pos")
    rows = rows.withColumn("balance", F.sum("way").over(order))
    # An end without a start takes the balance to a new low.
    low = F.least(F.lit(0), F.coalesce(F.min("balance").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("low", low).withColumn("step", F.when((F.col("way") < 0) & (F.col("balance") < F.col("low")), 0).otherwise(F.col("way")))
    return rows.withColumn("level", F.col("balance") - F.least("low", "balance") + F.when(F.col("step") < 0, 1).otherwise(0)).drop("way", "balance", "low")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), token, tag, and what it does: ``step`` is 1 for a start, -1 for an end that has one, else 0.

    Comments, scripts and styles have no tag; neither have texts.
    """
    return _stepped(_tagged(docs)).select("doc_id", "pos", "token", "tag", "step", "level")


def _ends_paragraph(ends: Column) -> Column:
    return (F.col("tag").isin(*ENDS_P) & ~ends) | (ends & (F.col("tag") != "") & ~F.col("tag").isin(*INLINE))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one document after the other, in their order, with their depth and parent; what is open in the document at hand is kept."""
    doc, lasts, above = None, [], defaultdict(list)
    for batch in batches:
        depths, parents = [], []
        for of, node, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "node", "last"))):
            if of != doc:
                doc, lasts, above = of, [], defaultdict(list)
            while lasts and lasts[0] < node:
                heappop(lasts)
            depth, outer = len(lasts), above[len(lasts) - 1]
            while outer and outer[-1][1] < node:
                outer.pop()
            depths.append(depth)
            parents.append(outer[-1][0] if outer else None)
            above[depth].append((node, last))
            heappush(lasts, last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depths, pa.int32()), pa.array(parents, pa.int32())], [*batch.schema.names, "depth", "parent"])


def document_tree(docs: DataFrame) -> DataFrame:
    """doc_id, node, tag, last, depth and parent of every element of documents (doc_id, html).

    ``node`` and ``last`` are the numbers of its first and last token; ``parent`` is the node of the innermost element
    around it, null at depth 0. A paragraph ends before the next block or at the end of one, an item before the next
    one of its list or at the list's end; another element without
    an end goes on to the end of the document, an inline one to the next start or end of a block. Ends without a start and
    tags without content are no elements. A null document has none. Documents move once, as tags without their text.
    """
    ends = F.col("token").startswith("</")
    rows = _tagged(docs).filter("tag <> ''").select("doc_id", "final", "pos", "tag", "way", ends.alias("ends"))
    # By its number, so that partitions aren't merged into few large ones, of which a task would hold every order.
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    pair = Window.partitionBy("doc_id", "tag", "level", F.col("step") == 0).orderBy("pos")
    rows = _stepped(rows).withColumn("end", F.when((F.col("step") == 1) & (F.lead("step").over(pair) == -1), F.lead("pos").over(pair)))
    # From the end of the document: the next edge of a block, and the lists that are open, counted from those at the end.
    later = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    edge = lambda x: F.last(F.when(_ends_paragraph(F.col("ends")), x), ignorenulls=True).over(later)
    listed = F.col("tag").isin("ul", "ol")
    rows = rows.withColumns({"stop": edge(F.col("pos")), "own": edge((F.col("tag") == "p") & (F.col("step") == -1)), "lists": -F.coalesce(F.sum(F.when(listed, F.col("step")).otherwise(0)).over(later), F.lit(0))})
    # An item ends with the next item of its list, or with the list.
    of = F.when(F.col("tag") == "li", F.col("lists")).when(listed & (F.col("step") == -1), F.col("lists") + 1)
    own = Window.partitionBy("doc_id", of).orderBy("pos")
    closed = (F.lead("tag").over(own) == "li") & F.lead("ends").over(own)
    rows = rows.withColumn("item", F.lead("pos").over(own) - F.when(closed, 0).otherwise(1))
    before = F.coalesce(F.col("stop") - 1, F.col("final"))
    cut = F.when(F.col("own"), F.col("stop")).otherwise(before)
    last = F.when(F.col("tag") == "p", cut).when(F.col("tag") == "li", F.coalesce("item", "final")).otherwise(F.coalesce("end", F.when(F.col("tag").isin(*INLINE), before).otherwise(F.col("final"))))
    nodes = rows.filter("step = 1").select("doc_id", F.col("pos").alias("node"), "tag", last.cast("int").alias("last")).sortWithinPartitions("doc_id", "node")
    shape = StructType([StructField(f.name, f.dataType) for f in nodes.schema] + [StructField("depth", IntegerType()), StructField("parent", IntegerType())])
    return nodes.mapInArrow(_nested, shape)


def sheltered(docs: DataFrame) -> DataFrame:
    """doc_id and html with the marks SHELTER and OPEN_AIR around texts that aren't loose wherever they stand.

    Text is loose if all elements around it are containers or inline; paragraphs and headings are left as they are.
    """
    rows = tokens(docs.withColumn("html", F.translate(F.coalesce("html", F.lit("")), SHELTER + OPEN_AIR, "")))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda test: F.coalesce(F.sum(F.when(test, F.col("step")).otherwise(0)).over(order), F.lit(0)) > 0
    paragraph = F.coalesce(F.last(F.when((F.col("tag") == "p") & (F.col("step") == 1), True).when(_ends_paragraph(F.col("token").startswith("</")), False), ignorenulls=True).over(order), F.lit(False))
    other = (F.col("tag") != "") & ~F.col("tag").isin("p", *HEADINGS, *CONTAINERS, *INLINE, *WRAPPERS)
    hidden = (F.col("tag") == "") & ~F.col("token").startswith("<") & inside(other) & ~inside(F.col("tag").isin(*HEADINGS)) & ~paragraph
    rows = rows.withColumn("part", F.when(hidden, F.concat(F.lit(SHELTER), "token", F.lit(OPEN_AIR))).otherwise(F.col("token")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("html"))
