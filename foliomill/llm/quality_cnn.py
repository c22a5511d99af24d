"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector. Learned filters of 8 bytes step over the text by 4 bytes;
their rectified answers are max-pooled in chunks of 512 bytes that overlap by 64, and the
chunks, which cover the whole text, are combined by their mean and maximum into one
probability. Learning and scoring share this path, for texts of any length: chunks go
through it in blocks.

The network is fitted on the whole texts of at most ``SAMPLE`` labelled documents. They are dealt
into ``LEARNERS`` groups; in each of ``ROUNDS`` rounds every group goes on from the same weights in
a task of its own, and the weights that come back are averaged. The driver holds weights only.

Defined results: a null or empty text is one chunk of zero bytes and gets its score; a document
with several label rows is learned once with the greatest; if one label is missing the score is
constant; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buffers, held_out, slices, table, texts
from .toxicity import labelled_sample

#: Labelled documents that the fit sees; groups that they are dealt into; rounds, and passes over the documents in each.
SAMPLE, LEARNERS, ROUNDS, EPOCHS = 4_000, 4, 6, 8
STEP, CHUNK, HOP = 4, 512, 448
WIDTH, FILTERS = 4, 24
#: Chunks that are filtered at once, and documents of a step.
BLOCK, DOCUMENTS = 1_024, 8
_STEPS = CHUNK // STEP
SHAPES = {"byte": (256, WIDTH), "near": (STEP * WIDTH, FILTERS), "far": (STEP * WIDTH, FILTERS), "bias": (FILTERS,), "out": (2 * FILTERS,), "base": (1,)}
SCALES = {"byte": 0.5, "near": 0.25, "far": 0.25}
Network = dict[str, np.ndarray]


def fresh(seed: int = 7) -> Network:
    """The network before learning."""
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, SCALES[k], shape).astype(np.float32) if k in SCALES else np.zeros(shape, np.float32) for k, shape in SHAPES.items()}


def packed(p: Network) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in SHAPES)


def unpacked(raw: bytes) -> Network:
    flat, out = np.frombuffer(raw, "<f4"), {}
    for k, shape in SHAPES.items():
        out[k], flat = flat[: np.prod(shape)].reshape(shape).copy(), flat[np.prod(shape) :]
    return out


def chunks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes of some chunks, padded with zeros; the text of each) until all texts are covered."""
    sizes = np.diff(ends)
    count = np.maximum(1, -(-(sizes - (CHUNK - HOP)) // HOP))
    before, data = np.cumsum(count) - count, np.r_[data, np.zeros(CHUNK, np.uint8)]
    for at in range(0, int(count.sum()), BLOCK):
        number = np.arange(at, min(at + BLOCK, int(count.sum())))
        of = np.searchsorted(before, number, "right") - 1
        start = ends[of] + (number - before[of]) * HOP
        place = start[:, None] + np.arange(CHUNK)
        yield np.where(place < ends[of + 1][:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8), of


def filtered(raw: np.ndarray, p: Network) -> tuple[np.ndarray, np.ndarray]:
    """(greatest answer, its place) of each filter in each chunk."""
    x = p["byte"][raw].reshape(len(raw), _STEPS, STEP * WIDTH)
    z = x[:, :-1] @ p["near"]
    z += x[:, 1:] @ p["far"]
    best = z.argmax(1)
    return np.take_along_axis(z, best[:, None], 1)[:, 0] + p["bias"], best


def pooled(h: np.ndarray, of: np.ndarray, texts_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts present, sums, maxima, chunk counts) of the chunks' rectified answers."""
    heads = np.flatnonzero(np.r_[True, np.diff(of) > 0])
    return of[heads], np.add.reduceat(h, heads), np.maximum.reduceat(h, heads), np.bincount(of, minlength=texts_)[of[heads]]


def probabilities(data: np.ndarray, ends: np.ndarray, p: Network) -> np.ndarray:
    """One probability for each text of a buffer."""
    n = len(ends) - 1
    total, most, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros((n, 1))
    for raw, of in chunks(data, ends):
        who, sums, top, size = pooled(np.maximum(filtered(raw, p)[0], 0), of, n)
        total[who] += sums
        most[who] = np.maximum(most[who], top)
        count[who, 0] += size
    z = np.concatenate([total / np.maximum(count, 1), most], 1) @ p["out"] + p["base"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradient(data: np.ndarray, ends: np.ndarray, labels: np.ndarray, p: Network) -> Network:
    """Slope of the mean log loss over whole texts."""
    n = len(labels)
    parts = [(raw, of, *filtered(raw, p)) for raw, of in chunks(data, ends)]
    of, top = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    h = np.maximum(top, 0)
    _, total, most, count = pooled(h, of, n)
    v = np.concatenate([total / count[:, None], most], 1)
    error = (1 / (1 + np.exp(-np.clip(v @ p["out"] + p["base"], -60, 60))) - labels) / n
    back = error[:, None] * p["out"]
    # The mean reaches every chunk of a text, the maximum the first chunk that has it.
    dz = (back[:, :FILTERS] / count[:, None])[of]
    heads = np.flatnonzero(np.r_[True, np.diff(of) > 0])
    first = np.minimum.reduceat(np.where(h == most[of], np.arange(len(of))[:, None], len(of)), heads)
    dz[first, np.arange(FILTERS)] += back[:, FILTERS:]
    dz *= top > 0
    out = {k: np.zeros(shape) for k, shape in SHAPES.items()} | {"out": v.T @ error + 1e-4 * p["out"], "base": np.array([error.sum()]), "bias": dz.sum(0)}
    at = 0
    for raw, _, _, best in parts:
        own, rows = dz[at : at + len(raw)], np.arange(len(raw))[:, None]
        at += len(raw)
        for name, shift in (("near", 0), ("far", 1)):
            seen = raw.reshape(len(raw), _STEPS, STEP)[rows, best + shift]
            out[name] += np.einsum("mf,mfi->if", own, p["byte"][seen].reshape(len(raw), FILTERS, STEP * WIDTH))
            slope = (own[:, :, None] * p[name].T[None]).reshape(-1, WIDTH)
            out["byte"] += np.stack([np.bincount(seen.reshape(-1), slope[:, i], 256) for i in range(WIDTH)], 1)
    return out


def fit(raws: list[bytes], labels: np.ndarray, p: Network, epochs: int, rate: float, seed: int) -> Network:
    """Goes on learning from whole texts, by Adam steps."""
    rng = np.random.default_rng(seed)
    first, second, t = {k: np.zeros(s) for k, s in SHAPES.items()}, {k: np.zeros(s) for k, s in SHAPES.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for at in range(0, len(order), DOCUMENTS):
            some = [raws[i] for i in order[at : at + DOCUMENTS]]
            ends = np.cumsum([0, *map(len, some)])
            slope = gradient(np.frombuffer(b"".join(some), np.uint8), ends, labels[order[at : at + DOCUMENTS]], p)
            t += 1
            for k in p:
                first[k] += 0.1 * (slope[k] - first[k])
                second[k] += 0.001 * (slope[k] ** 2 - second[k])
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def _learner(start: bytes, epochs: int, rate: float, seed: int):
    """One group of labelled documents (doc_id, label, text) to (documents, weights)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id").combine_chunks()
        raws = [x.encode() for x in rows["text"].to_pylist()]
        p = fit(raws, rows["label"].to_numpy().astype(np.float64), unpacked(start), epochs, rate, seed)
        return pa.table({"n": pa.array([len(raws)], pa.int64()), "weights": pa.array([packed(p)], pa.binary())})

    return run


def learn(rows: DataFrame, rounds: int = ROUNDS, epochs: int = EPOCHS) -> Network:
    """The network from labelled rows (doc_id, label, text), SAMPLE at most."""
    with Scratch(rows.sparkSession) as scratch:
        dealt = scratch.written(rows.select("doc_id", "label", "text", F.pmod(F.xxhash64("doc_id"), F.lit(LEARNERS)).alias("learner")), "labelled")
        seen = {r.label: r.n for r in dealt.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
        p = fresh()
        if not seen.get(0) or not seen.get(1):
            return p | {"out": np.zeros(2 * FILTERS, np.float32), "base": np.array([20.0 if seen.get(1) else -20.0 if seen.get(0) else 0.0], np.float32)}
        for i in range(rounds):
            work = _learner(packed(p), epochs, 0.004 * (1 - i / rounds) + 1e-4, i)
            found = dealt.groupBy("learner").applyInArrow(work, "n long, weights binary").collect()  # LEARNERS rows
            found = sorted((r.n, bytes(r.weights)) for r in found)
            p = unpacked(packed({k: sum(n * unpacked(w)[k] for n, w in found) / sum(n for n, _ in found) for k in SHAPES}))
    return p


def _score(p: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(*buffers(batch.column(1)), p))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score, 0 to 1."""
    return texts(docs).mapInArrow(_score(network), "doc_id long, score double")


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labelled ones that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = learn(labelled_sample(docs, labels.filter(~held_out(4, 2)), "quality", SAMPLE))
    return score(docs, network).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op7_quality_cnn": op7_quality_cnn}
ORACLE_SQL: dict[str, str] = {}
