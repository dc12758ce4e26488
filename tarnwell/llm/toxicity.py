"""Toxicity scores from non-negative positive-unlabelled learning.

A logistic model on the distinct words and five-byte character grams of a text is trained in numpy
from confirmed toxic examples (P) and unlabelled text (U). U is drawn from the rows whose label may
be learned from, toxic ones included, and its labels are not looked at; the class prior p is the
share of toxic rows among those rows. Features whose share differs clearly between P and U are
chosen first, by counts made on executors. With the prior the risk of calling U negative contains
the toxic part of U, which P estimates: risk = m * p * R_P(+) + max(0, R_U(-) - p * R_P(-)). m is
``missed``, how many times as bad a missed toxic text is as a false alarm; m = 1 gives the plain
estimator of the error risk, and the m that is trained with is that of Learning. The maximum
keeps the negative part from going below zero; where it does, its gradient step is reversed
(non-negative correction). Scores are computed by executors over whole texts.

The training set is a bounded sample of labelled rows, the bounds are parameters; rows are drawn by
a hash of their id, so that the same rows are drawn whatever the partitioning. What reaches the
driver are the chosen features and which of them each sampled text has. Nothing but the text enters
a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BLOCK, mix64, pieces, word_lists
from .scratch import Scratch, arrow_batches

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Learning:
    """max_positive, max_unlabelled: bounds of the training sample (labelled rows, in expectation).

    bits: features are hashed to 2**bits numbers. least_documents: toxic training texts that a
    feature must be in. clear: least z-score of the difference of its shares. max_features: weights
    of the model. l2: weight decay. margin: risk below which the negative part is reversed. missed:
    how many times as bad a missed toxic text is as a false alarm; weight of the positive part.
    """

    max_positive: int = 4000
    max_unlabelled: int = 12000
    bits: int = 22
    least_documents: int = 4
    clear: float = 3.0
    max_features: int = 6000
    steps: int = 300
    rate: float = 0.05
    l2: float = 1e-5
    margin: float = 0.0
    missed: float = 4.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """features: ascending numbers; weights: float32 of each; bias. A text scores sigmoid(bias + sum of its features' weights)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def _table(self) -> np.ndarray:
        """Of each number its place among the features or -1; made once for each Python worker's copy of the model."""
        if "places" not in self.__dict__:
            table = np.full(1 << self.bits, -1, np.int32)
            table[self.features] = np.arange(len(self.features))
            self.__dict__["places"] = table
        return self.__dict__["places"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "places"}  # not sent to executors

    def scores(self, texts: list[bytes]) -> np.ndarray:
        table = self._table()
        width = max(1, len(self.features))
        cut = [(i, y) for i, x in enumerate(texts) for y in _cuts(x)]
        owners, blocks = np.array([x[0] for x in cut], np.int64), [x[1] for x in cut]
        pairs = [np.zeros(0, np.int64)]
        for part in pieces(blocks):
            number, owner = features_of(blocks[part], self.bits)
            known = table[number]
            hit = np.flatnonzero(known >= 0)
            pairs.append(np.unique(owners[part][owner[hit]] * np.int64(width) + known[hit]))
        pair = np.unique(np.concatenate(pairs))
        out = self.bias + np.bincount(pair // width, weights=self.weights[pair % width] if len(pair) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in blocks of about a megabyte, cut at blanks, where no feature is lost."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        end = next((k for k in (text.find(b" ", at + BLOCK), text.find(b"\n", at + BLOCK)) if k >= 0), len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def features_of(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, text): hashed words and character grams of each text, with repetitions.

    Letters are lower-cased, ASCII signs count as blanks; a gram may begin at the blank before a word.
    """
    plain = [b" " + x.translate(_PLAIN) for x in texts]
    word, bounds = word_lists(plain)
    flat = np.frombuffer(b"".join(plain) + b"    ", np.uint8).astype(np.uint64)
    n = len(flat) - 4
    gram = np.zeros(n, np.uint64)
    for k in range(5):
        gram = (gram << np.uint64(8)) | flat[k : k + n]
    ends = np.cumsum([len(x) for x in plain])
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in plain])
    blank = flat == 32
    inside = (np.arange(n) + 5 <= ends[owner]) & ~(blank[1 : n + 1] | blank[2 : n + 2] | blank[3 : n + 3] | blank[4 : n + 4])
    number = np.concatenate([word, mix64(gram[inside] ^ np.uint64(0x6A09E667F3BCC909))]) >> np.uint64(64 - bits)
    return number.astype(np.int64), np.concatenate([np.repeat(np.arange(len(texts)), np.diff(bounds)), owner[inside]])


def risk(weight: np.ndarray, word: np.ndarray, owner: np.ndarray, n_pos: int, n_un: int, prior: float, margin: float = 0.0, missed: float = 1.0) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient to step along) of the risk with logistic loss.

    weight: of each feature, the bias last. word, owner: the features and the text of each entry; the
    first n_pos texts are toxic, the next n_un unlabelled; missed weighs the positive part. The gradient is that of the sum of both
    parts, or, where the negative part is below -margin, that of the negative part reversed.
    """
    score = np.bincount(owner, weights=weight[word], minlength=n_pos + n_un) + weight[-1]
    p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    toxic, clean = np.logaddexp(0, -score), np.logaddexp(0, score)  # losses of calling a text negative, positive
    positive = missed * prior * toxic[:n_pos].mean()
    negative = clean[n_pos:].mean() - prior * clean[:n_pos].mean()
    slope = np.zeros(len(score))
    if negative >= -margin:
        slope[:n_pos] = missed * prior * (p[:n_pos] - 1) / n_pos - prior * p[:n_pos] / n_pos
        slope[n_pos:] = p[n_pos:] / n_un
    else:
        slope[:n_pos] = prior * p[:n_pos] / n_pos
        slope[n_pos:] = -p[n_pos:] / n_un
    return positive, negative, np.append(np.bincount(word, weights=slope[owner], minlength=len(weight) - 1), slope.sum())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, names: np.ndarray, how: Learning) -> Model:
    """Weights of the features ``names`` (ascending) from those that each toxic and each unlabelled text has.

    Without toxic texts, unlabelled texts or features every score is 0.
    """
    if not positive or not unlabelled or prior <= 0 or not len(names):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0, how.bits)
    rows = [np.searchsorted(names, x) for x in positive + unlabelled]
    word, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    weight = np.zeros(len(names) + 1)
    weight[-1] = float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, how.steps + 1):
        _, _, g = risk(weight, word, owner, len(positive), len(unlabelled), prior, how.margin, how.missed)
        g[:-1] += how.l2 * weight[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        weight -= how.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(names.astype(np.int64), weight[:-1].astype(np.float32), float(weight[-1]), how.bits)


def _distinct_features(bits: int):
    schema = pa.schema([("toxic", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                out.append(np.unique(np.concatenate([np.unique(features_of([x], bits)[0]) for x in _cuts(text or b"")])).astype("<u4").tobytes())
            yield pa.record_batch([batch.column("toxic"), pa.array(out, pa.binary())], schema=schema)

    return run


def _counted(bits: int):
    """In how many texts of each part a feature is, added up for each batch."""
    schema = pa.schema([("feature", pa.int64()), ("p", pa.int64()), ("u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = batch.column("words").to_pylist(), batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            every = np.frombuffer(b"".join(words), "<u4").astype(np.int64)
            of = np.repeat(toxic, [len(x) // 4 for x in words])
            names, at = np.unique(every, return_inverse=True)
            both = [np.bincount(at[x], minlength=len(names)) for x in (of, ~of)]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (names, *both)], schema=schema)

    return run


def _chosen(sample: DataFrame, n_pos: int, n_un: int, how: Learning) -> np.ndarray:
    """The features whose shares in both parts differ most clearly, ascending; at most max_features of them."""
    counts = sample.mapInArrow(_counted(how.bits), "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    seen = counts.filter((F.col("p") >= how.least_documents) | (F.col("u") >= 10 * how.least_documents))
    p, q, both = (F.col("p") + 0.5) / (n_pos + 1), (F.col("u") + 0.5) / (n_un + 1), (F.col("p") + F.col("u") + 1) / (n_pos + n_un + 2)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_un))
    rows = seen.select("feature", F.round(z, 9).alias("z")).filter(F.col("z") >= how.clear).orderBy(F.col("z").desc(), "feature").limit(how.max_features)
    return np.sort(np.array([r.feature for r in rows.collect()], np.int64))


def _restricted(names: np.ndarray):
    schema = pa.schema([("toxic", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.intersect1d(np.frombuffer(x, "<u4"), names, assume_unique=True).astype("<u4").tobytes() for x in batch.column("words").to_pylist()]
            yield pa.record_batch([batch.column("toxic"), pa.array(words, pa.binary())], schema=schema)

    return run


def _drawn(rows: int, most: int, seed: int) -> Column:
    """True for about ``most`` of ``rows`` ids, by a hash of the id."""
    grain = 1 << 30
    part = grain if rows <= most else grain * most // rows
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(grain).cast("long")) < F.lit(part).cast("long")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from: crc32 of the id as text modulo 5 is 0; null ids too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, how: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from the labels of rows that are not held out.

    The class prior is the share of toxic rows among them. Null labels and null ids are left out, a
    row without a document too; copies of a text count once. A label given twice with both values is
    toxic. Without toxic rows, or with nothing else, every score is 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null").filter(~held_out("id"))
    known = known.groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    rows, toxic = known.agg(F.count("*"), F.sum("y")).first()
    if not rows or not toxic:
        return fit([], [], 0.0, np.zeros(0, np.int64), how)
    part = known.select("id", ((F.col("y") == 1) & _drawn(toxic, how.max_positive, how.seed)).alias("p"), _drawn(rows, how.max_unlabelled, how.seed + 1).alias("u")).filter("p or u")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").filter(~held_out("id"))
    drawn = texts.join(F.broadcast(part), "id")  # about max_positive + max_unlabelled ids
    parts = F.explode(F.array_compact(F.array(F.when(F.col("p"), True), F.when(F.col("u"), False))))
    sample = scratch.save(drawn.select(parts.alias("toxic"), "text").mapInArrow(_distinct_features(how.bits), "toxic boolean, words binary").distinct(), "sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit([], [], 0.0, np.zeros(0, np.int64), how)
    names = _chosen(sample, n[True], n[False], how)
    got = sorted((r.toxic, bytes(r.words)) for r in sample.mapInArrow(_restricted(names), "toxic boolean, words binary").collect())
    scratch.drop(sample)
    positive, unlabelled = ([np.frombuffer(x, "<u4").astype(np.int64) for y, x in got if y is want] for want in (True, False))
    return fit(positive, unlabelled, toxic / rows, names, how)


def _score(model: Model):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(model.scores(texts), pa.float64())], schema=schema)

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, held_out, score, predicted). Null and empty texts score by the bias alone.

    Rows with a null id are scored and count as held out; repeated rows are each scored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) < 0.5))

    return run


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(model, text_col), docs.schema)
