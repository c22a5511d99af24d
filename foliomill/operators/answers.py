"""Search, passage ranking and reuse of answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from foliomill.functions import text as T
from foliomill.functions.rows import each

#: Words that say nothing about a question.
COMMON = "the what who how why when where which does did are was were this that and for with about can you que qual quais quem como por porque quando onde uma umas uns dos das para com sobre isso esse essa este esta foi sao ser tem del los las una cual quien esto eso fue".split()


#: Needles of one automaton.
PART = 20_000


def terms(col: Column) -> Column:
    """Folded words of three letters or digits or more."""
    return F.regexp_extract_all(T.fold(col), F.lit(r"([\p{L}\p{N}]{3,})"), 1)


def _first_places(needles: list[tuple[int, str]]):
    """Blocks with folded text to (block, query, first place) by one automaton for all needles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for query, needle in needles:
            found.add_word(needle, (*found.get(needle, ()), query))
        if not len(found):
            return
        found.make_automaton()
        size = dict(needles)
        for batch in batches:
            row, query_id, place = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                first: dict[int, int] = {}
                for end, queries in found.iter(text or ""):
                    for q in queries:
                        first.setdefault(q, end - len(size[q]) + 2)
                row += [i] * len(first)
                query_id += first.keys()
                place += first.values()
            kept = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(query_id, pa.int64()), pa.array(place, pa.int32())], [*batch.schema.names[:-1], "query_id", "at"])

    return run


def search_blocks(blocks: DataFrame, queries: DataFrame, part: int = PART) -> DataFrame:
    """Blocks (doc_id, block_no, text) that hold a query (query_id, needle), without regard to case and accents, with the text around the first place.

    Queries are counted before they go out: each ``part`` of them is one automaton, dealt by hash, and blocks are read
    once for each. Needles that are null or empty find nothing.
    """
    needles = queries.select(F.col("query_id").cast("long"), T.fold(F.col("needle")).alias("needle"), F.length("needle").alias("size")).filter("needle <> ''")
    folded = blocks.select("doc_id", "block_no", "text", T.fold(F.col("text")).alias("_folded"))
    shape = StructType([*folded.schema.fields[:-1], StructField("query_id", LongType()), StructField("at", IntegerType())])
    parts = max(1, -(-needles.count() // part))
    hit = None
    for k in range(parts):
        own = needles.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        found = folded.mapInArrow(_first_places(sorted((r.query_id, r.needle) for r in own.collect())), shape)  # about ``part`` needles
        found = found.join(F.broadcast(own.select("query_id", "size")), "query_id")  # the same
        hit = found if hit is None else hit.unionByName(found)
    at = F.col("at")
    before = F.substring("text", F.greatest(at - 70, F.lit(1)), F.least(at - 1, F.lit(70)))
    return hit.select("query_id", "doc_id", "block_no", before.alias("before"), F.substring("text", at, F.col("size")).alias("match"), F.substring("text", at + F.col("size"), F.lit(90)).alias("after"))


def block_prefixes(blocks: DataFrame, size: int = 60) -> DataFrame:
    """doc_id, block_no, block (its first characters) and dup, the earlier blocks of the document that begin alike.

    Together they name a block of :func:`search_blocks` for a reader who knows the document's text alone.
    """
    rows = blocks.select("doc_id", "block_no", F.substring("text", 1, size).alias("block"))
    return rows.withColumn("dup", (F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("block_no")) - 1).cast("long"))


def _passage_terms(passages: list[dict]) -> list[tuple]:
    """(term, passage_no, tf, df, n) of one document."""
    counts: dict[object, Counter] = {}
    for p in passages:
        counts.setdefault(p["passage_no"], Counter()).update(p["terms"] or ())
    df = Counter(term for own in counts.values() for term in own)
    return [(term, no, tf, df[term], len(passages)) for no, own in counts.items() for term, tf in own.items()]


def passage_terms(passages: DataFrame) -> DataFrame:
    """doc_id, passage_no, term, tf, df (passages of the document with the term) and n (its passages).

    The passages of a document meet once, as they are; its terms are counted one document after the other.
    """
    held = F.collect_list(F.struct("passage_no", terms(F.col("text")).alias("terms"))).alias("passages")
    rows = passages.select("doc_id", "passage_no", "text").repartition("doc_id").groupBy("doc_id").agg(held)
    made = StructType([StructField("term", StringType()), StructField("passage_no", passages.schema["passage_no"].dataType), *(StructField(c, LongType()) for c in ("tf", "df", "n"))])
    return each(rows, ["passages"], made, _passage_terms, "number").drop("number")


def rank_passages(questions: DataFrame, found: DataFrame) -> DataFrame:
    """question_id, passage_no, score and rank of passages within the question's document."""
    asked = questions.select("question_id", "doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("n") / F.col("df"))
    scored = asked.join(found, ["doc_id", "term"]).groupBy("question_id", "passage_no").agg(F.round(F.sum(weight), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "passage_no")))


def question_vectors(questions: DataFrame) -> DataFrame:
    """question_id, stem and weight, of length 1 for each question."""
    stems = F.transform(F.filter(terms(F.col("text")), lambda x: ~x.isin(COMMON)), lambda x: F.substring(x, 1, 6))
    counts = questions.select("question_id", F.explode(stems).alias("stem")).groupBy("question_id", "stem").agg(F.count("*").alias("c"))
    return counts.withColumn("w", F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("question_id")))).drop("c")


def _prefixes(vectors: DataFrame, counts: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The rarest stems of each vector (keys, id, stem, w), so many that what is left of it is shorter than ``least``.

    Two vectors of length 1 with a cosine of ``least`` share a stem; their first one, in the order of rarity, stands
    in the prefixes of both, for what comes behind a prefix can't reach that cosine alone.
    """
    ranked = vectors.join(counts, [*keys, "stem"])
    common = Window.partitionBy(*keys, "id").orderBy(F.desc("n"), F.desc("stem")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(common)).filter(F.col("rest") >= least * least - 1e-9).select(*keys, "id", "stem")


def answer_candidates(questions: DataFrame, answers: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, id and other: pairs of vectors (keys, id, stem, w) that may have a cosine of ``least``."""
    counts = questions.select(*keys, "stem").unionAll(answers.select(*keys, "stem")).groupBy(*keys, "stem").agg(F.count("*").alias("n"))
    asked, saved = (_prefixes(v, counts, keys, least) for v in (questions, answers))
    return asked.join(saved.withColumnRenamed("id", "other"), [*keys, "stem"]).select(*keys, "id", "other").distinct()


def reuse_answers(questions: DataFrame, answers: DataFrame, least: float = 0.85) -> DataFrame:
    """question_id, answer_id and cosine: the best saved answer of the same document, the smallest answer_id among equals.

    ``questions``: question_id, doc_id, text; ``answers``: answer_id, doc_id, question. Where both have a column
    ``sig`` (of the document's state and the assistant's settings), only an answer with the question's own counts.
    Equal texts are one vector; pairs are made where prefixes of rare stems meet, and their cosines are exact. A null
    document or text finds nothing.
    """
    keys = ["doc_id", *(["sig"] if "sig" in questions.columns and "sig" in answers.columns else [])]
    # A number for each text of a document, on both sides.
    named = lambda df, text: df.withColumn("id", F.xxhash64(*keys, text))
    asked = named(questions.select("question_id", *keys, F.col("text")), "text")
    saved = named(answers.select("answer_id", *keys, F.col("question").alias("text")), "text")

    def vectors(rows: DataFrame) -> DataFrame:
        once = rows.groupBy(*keys, "id").agg(F.first("text").alias("text"))
        return question_vectors(once.withColumnRenamed("id", "question_id")).withColumnRenamed("question_id", "id").join(once.select(*keys, "id"), "id")

    q, a = vectors(asked), vectors(saved)
    maps = lambda v, name: v.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "w"))).alias(name))
    pairs = answer_candidates(q, a, keys, least).select("id", "other").join(maps(q, "v"), "id").join(maps(a, "u").withColumnRenamed("id", "other"), "other")
    shared = F.transform(F.array_sort(F.array_intersect(F.map_keys("v"), F.map_keys("u"))), lambda x: F.col("v")[x] * F.col("u")[x])
    near = pairs.select("id", "other", F.round(F.aggregate(shared, F.lit(0.0), lambda s, x: s + x), 6).alias("cosine")).filter(F.col("cosine") >= least)
    first = saved.groupBy(F.col("id").alias("other")).agg(F.min("answer_id").alias("answer_id"))
    best = near.join(first, "other").groupBy("id").agg(F.max(F.struct("cosine", (-F.col("answer_id")).alias("back"))).alias("best"))
    return asked.select("question_id", "id").join(best, "id").select("question_id", (-F.col("best.back")).alias("answer_id"), "best.cosine")


def trim_history(turns: DataFrame, last: int = 4, chars: int = 2000) -> DataFrame:
    """The last turns of user and assistant of each conversation, from the first user turn among them."""
    rows = turns.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_r") <= last)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("_f", first).filter("turn >= _f").select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("text"))
