"""Toxicity scores from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled learning: a linear model over the words and
word parts of a text is fitted by gradient descent on a risk (of the sigmoid
loss, which is bounded) that needs no negative labels. With the class prior p, the risk of the negatives is that of
all unlabelled text as negative, less p times that of the positives as
negative; where this estimate falls below zero, which only over-fitting brings
about, the step goes the other way.

The model is fitted on the driver with numpy, on a sample of bounded size
(``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents, drawn by a hash of the
doc_id). Scoring runs over all rows and whole texts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, count_sketch, cut, held

MAX_POSITIVE = 2_000
MAX_UNLABELLED = 6_000
MAX_FEATURES = 4_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SPACE = 1 << 22
CACHE = 60_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a whole text: runs of letters, A-Z lower-cased, in UTF-8."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def _parts(word: bytes):
    marked = b"^" + word + b"$"
    yield zlib.crc32(marked) % SPACE
    for n in (4, 5, 6):
        for i in range(len(marked) - n + 1):
            yield zlib.crc32(marked[i : i + n]) % SPACE


def parts_of(word: bytes) -> set[int]:
    """A word's features, hashed: the word itself and its runs of 4 to 6 bytes, edges marked.

    Of a word of any length all runs count; text without blanks is one word.
    """
    return set(_parts(word))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    @property
    def mark(self) -> int:
        return hash((self.bias, *sorted(self.weights.items())))

    def score(self, words: set[bytes], known: Recent) -> float:
        """The score of a text with these words; ``known`` gives a word's features that have weights."""
        got = {x for w in words for x in known[w]}
        z = self.bias + sum(self.weights[x] for x in sorted(got))
        return 1 / (1 + math.exp(-z)) if z > -30 else 0.0

    def table(self) -> Recent:
        return Recent(lambda w: tuple({x for x in _parts(w) if x in self.weights}), CACHE)


def table_of(shared) -> Recent:
    """A worker's table for a broadcast model."""
    return held(("toxicity", shared.value.mark), shared.value.table)


def telling(k: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
    """The features whose frequency differs most between ``n`` positives and ``m`` unlabelled documents.

    ``k`` and ``j`` count the documents of either side that have each feature.
    ``z`` compares the frequencies with a pooled variance; a feature also has
    to be at least twice as frequent among the positives, which keeps out word
    parts that only follow the length of the texts.
    """
    n, m = max(1, n), max(1, m)
    at = np.flatnonzero(k >= max(5, n / 200))
    k, j = k[at].astype(np.int64), j[at].astype(np.int64)
    a, b, p = (k + 0.5) / (n + 1), (j + 0.5) / (m + 1), (k + j + 1) / (n + m + 2)
    z = (a - b) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))
    z[(a < 2 * b) | (z < 5)] = 0
    order = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return at[order[z[order] > 0]]


class Sparse:
    """Documents by features, as the places of the ones; the last feature is always on."""

    def __init__(self, cols: list[np.ndarray], width: int):
        self.shape = len(cols), width + 1
        self.rows = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
        self.cols = np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0]) + w[-1]

    def mean_by_feature(self, r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.cols, r[self.rows], self.shape[1])[:-1], r.sum()) / len(r)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slope(p: Sparse, u: Sparse, w: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """The direction of a step down the non-negative risk."""
    sp, su = sigmoid(p.times(w)), sigmoid(u.times(w))
    dp, du = sp * (1 - sp), su * (1 - su)  # slopes of the sigmoid loss
    as_negative = su.mean() - prior * sp.mean()
    up_positive = -prior * p.mean_by_feature(dp)
    negative = u.mean_by_feature(du) - prior * p.mean_by_feature(dp)
    return (up_positive + negative if as_negative >= 0 else -negative) + decay * np.append(w[:-1], 0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: np.ndarray, prior: float, epochs: int = 800, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Fit the non-negative risk on documents given as arrays of places in ``names``.

    Without positives, unlabelled text or telling features nothing is learned:
    all texts score alike, the prior or half the threshold, whichever is less,
    and none is rejected. Empty documents are documents without features.
    """
    prior = min(max(prior, 1e-3), 0.5)
    if not len(names) or not unlabelled or not positive:
        same = min(prior, THRESHOLD / 2)
        return Model({}, math.log(same / (1 - same)))
    start = math.log(prior / (1 - prior))
    p, u = Sparse(positive, len(names)), Sparse(unlabelled, len(names))
    w = np.append(np.zeros(len(names)), start)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        grad = slope(p, u, w, prior, decay)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model({int(x): float(v) for x, v in zip(names, w[:-1], strict=True) if v}, float(w[-1]))


def _parts_of_texts(texts):
    for text in texts:
        yield np.array(sorted({x for word in words_of(text.as_py()) for x in parts_of(word)}), np.int64)


def _places(chosen: DataFrame, names: np.ndarray) -> DataFrame:
    """doc_id, positive, unlabelled and the places in ``names`` of each document's features, at most all of them."""
    order = np.argsort(names)
    shared = chosen.sparkSession.sparkContext.broadcast((names[order], order))

    def run(batches):
        sorted_, at = shared.value
        for batch in batches:
            rows = []
            for parts in _parts_of_texts(batch.column("text")):
                spot = np.minimum(np.searchsorted(sorted_, parts), max(0, len(sorted_) - 1))
                rows.append(at[spot[sorted_[spot] == parts]].astype(np.int32) if len(sorted_) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "positive", "unlabelled")), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "positive", "unlabelled", "at"])

    return chosen.mapInArrow(run, "doc_id long, positive boolean, unlabelled boolean, at array<int>")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the documents outside the held-out fold.

    ``labels`` (doc_id, toxic) confirms positives; everything outside the
    fold, whatever its label, is drawn from as unlabelled text, so that it holds
    the positives at their natural rate. The class prior is the share of toxic
    among the labelled documents outside the fold. Null doc_ids and labels are ignored;
    of several labels of a document the largest counts, of several texts of a
    doc_id the smallest. Features are found by the workers; to the driver come
    counts by feature and, per document, the places of at most ``MAX_FEATURES``.
    """
    inside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(inside & F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n, k = labels.agg(F.count("*"), F.count_if("toxic")).first()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(inside & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", F.lit("sample"))
    ids = docs.select("doc_id").distinct()
    chosen = [
        ids.join(labels.where("toxic"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(MAX_POSITIVE),
        ids.orderBy(order, "doc_id").limit(MAX_UNLABELLED),
    ]
    wanted = [{r.doc_id for r in x.collect()} for x in chosen]
    sample = docs.sparkSession.createDataFrame([(x, x in wanted[0], x in wanted[1]) for x in sorted(wanted[0] | wanted[1])], "doc_id long, positive boolean, unlabelled boolean")
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.min("text").alias("text"))
    texts = cut(texts.repartition(32))
    counts = [count_sketch(texts.where(side), lambda b: (x.astype(np.uint64) for x in _parts_of_texts(b.column("text"))), SPACE.bit_length() - 1) for side in ("positive", "unlabelled")]
    names = telling(*counts, *(len(x) for x in wanted))
    rows = sorted(_places(texts, names).collect())
    return fit(*([np.array(r[3], np.int64) for r in rows if r[side]] for side in (1, 2)), names, k / n if n else 0.1)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts score what a text without features scores. A row with
    a null doc_id is not held out. Rows are independent: repeated rows come
    back as often as they are there; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache = table_of(shared)
        for batch in batches:
            score = [float(shared.value.score(words_of(t.as_py()), cache)) for t in batch.column("text")]
            held = [x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold.

    All columns stay, under any name. Null and empty texts score as texts
    without features; repeated rows go or stay alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns
    at = names.index("text")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        cache = table_of(model)
        for batch in batches:
            keep = [model.value.score(words_of(t.as_py()), cache) < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, train(docs, labels))
