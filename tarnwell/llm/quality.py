"""Quality scores from compression: zstandard dictionaries of good and of bad text.

Half of the labelled texts that may be learned from (halves are told by a hash of the text, so copies
stay together) give two dictionaries, one trained on blocks of good text and one on blocks of bad
text. A text is cut into blocks, every block is compressed with either dictionary, and with the sums
g and b of the sizes its feature is (b - g) / (b + g): text that is like the good text becomes smaller
with its dictionary. The other half of the texts calibrates the feature: a logistic curve with
smoothed targets (Platt) turns it into the probability of label 1. Whole texts are compressed, in
blocks of a few kilobytes, as a dictionary helps only at the beginning of what is compressed.

The labelled texts are a sample of at most ``max_rows``, at one rate for both labels, and the blocks
for a dictionary one of at most ``max_blocks``, both in expectation. They are drawn by hashes, so the
same rows are drawn whatever the partitioning. Blocks and features reach the driver, nothing else.
Nothing but the text enters a score.

Null and empty texts have the feature 0 and get the score of it. Rows with a null id are scored and
count as held out; repeated rows are each scored. Without labels of both kinds every score is the
smoothed share of label 1. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, arrow_batches


@dataclass(frozen=True)
class Learning:
    """block: bytes compressed at once; dictionary: bytes of a dictionary; level: of zstandard.

    max_rows: labelled rows that are learned from; max_blocks: blocks of each label for a dictionary;
    both in expectation. modulus, held_out: labels of ids whose crc32 as text leaves this remainder
    are not learned from.
    """

    block: int = 4096
    dictionary: int = 1 << 18
    level: int = 3
    max_rows: int = 40_000
    max_blocks: int = 6000
    modulus: int = 3
    held_out: int = 1
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """good, bad: contents of the dictionaries; score = sigmoid(slope * feature + shift). Without dictionaries the feature is 0."""

    good: bytes
    bad: bytes
    slope: float
    shift: float
    how: Learning

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        """Made once for each Python worker's copy of the model."""
        if "made" not in self.__dict__:
            self.__dict__["made"] = [_compressor(x, self.how) for x in (self.good, self.bad)]
        return self.__dict__["made"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}  # not sent to executors

    def feature(self, text: bytes) -> float:
        if not text or not self.good or not self.bad:
            return 0.0
        good, bad = self._compressors()
        g = b = 0
        for at in range(0, len(text), self.how.block):
            part = text[at : at + self.how.block]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / (b + g)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * features + self.shift, -40, 40)))


def _compressor(content: bytes, how: Learning) -> zstandard.ZstdCompressor:
    table = zstandard.ZstdCompressionDict(content)
    table.precompute_compress(level=how.level)
    return zstandard.ZstdCompressor(dict_data=table, write_content_size=False, write_dict_id=False, write_checksum=False)


def dictionary(blocks: list[bytes], how: Learning) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(how.dictionary, blocks, level=how.level).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[: how.dictionary]


def curve(feature: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve with smoothed targets, by Newton steps; slope 0 where the feature tells nothing."""
    n1 = float(good.sum())
    n0 = len(good) - n1
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = float(feature.std()) if len(feature) else 0.0
    if spread == 0.0 or not n0 or not n1:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([(feature - feature.mean()) / spread, np.ones(len(feature))], 1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    loss = lambda w: float((np.logaddexp(0, x @ w) - target * (x @ w)).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * feature.mean() / spread)


def held_out(how: Learning, id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from; null ids too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(how.modulus)) == how.held_out, F.lit(True))


def _drawn(key: Column, rows: int, most: int) -> Column:
    """True for about ``most`` of ``rows`` keys, by their hash."""
    grain = 1 << 30
    return F.pmod(key, F.lit(grain).cast("long")) < F.lit(grain if rows <= most else grain * most // rows).cast("long")


def _blocks(how: Learning):
    schema = pa.schema([("good", pa.bool_()), ("place", pa.int32()), ("of", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for good, of, text in zip(*(batch.column(c).to_pylist() for c in ("good", "of")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for at in range(0, len(text), 256 * how.block):
                    cut = [text[k : k + how.block] for k in range(at, min(len(text), at + 256 * how.block), how.block)]
                    place = np.arange(len(cut)) + at // how.block
                    yield pa.record_batch([pa.array([good] * len(cut)), pa.array(place, pa.int32()), pa.array([of] * len(cut), pa.int64()), pa.array(cut, pa.binary())], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, how: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model from the labels of rows that are not held out.

    Null labels and ids are left out, a row without a document too, copies of a text count once. A
    label given with both values, to an id or to copies of a text, is bad.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null").filter(~held_out(how, "id"))
    known = known.groupBy("id").agg(F.min((F.col("y") == 1).cast("int")).alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").filter(~held_out(how, "id")).filter(F.length("text") > 0)
    part = known.filter(_drawn(F.xxhash64("id", F.lit(how.seed + 1)), known.count(), how.max_rows))
    rows = texts.join(F.broadcast(part), "id").groupBy("text").agg(F.min("y").alias("y")).select("text", (F.col("y") == 1).alias("good"), F.xxhash64("text", F.lit(how.seed)).alias("of"))
    rows = scratch.save(rows, "labelled")
    first, second = F.pmod("of", F.lit(2)) == 0, F.pmod("of", F.lit(2)) == 1
    count = {(r.good, r.half): r for r in rows.groupBy("good", first.alias("half")).agg(F.count("*").alias("n"), F.sum(F.ceil(F.octet_length("text") / F.lit(how.block))).alias("blocks")).collect()}
    n = {good: sum(r.n for (g, _), r in count.items() if g is good) for good in (True, False)}
    if any((good, True) not in count for good in n):  # no dictionary of one of the labels
        return Model(b"", b"", 0.0, float(np.log((n[True] + 1) / (n[False] + 1))), how)
    cut = rows.filter(first).select("good", "of", "text").mapInArrow(_blocks(how), "good boolean, place int, of long, block binary")
    key = F.xxhash64("of", "place", F.lit(how.seed))
    keep = F.when(F.col("good"), _drawn(key, int(count[True, True].blocks), how.max_blocks)).otherwise(_drawn(key, int(count[False, True].blocks), how.max_blocks))
    got = cut.filter(keep).collect()
    blocks = {good: [bytes(r.block) for r in sorted((r for r in got if r.good is good), key=lambda r: (r.of, r.place))] for good in n}
    model = Model(dictionary(blocks[True], how), dictionary(blocks[False], how), 1.0, 0.0, how)
    pairs = sorted((r.feature, r.good) for r in rows.filter(second).select("good", "text").mapInArrow(_features(model), "good boolean, feature double").collect())
    scratch.drop(rows)
    slope, shift = curve(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], bool))
    return Model(model.good, model.bad, slope, shift, how)


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature = [model.feature(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("good"), pa.array(feature, pa.float64())], names=["good", "feature"])

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature = np.array([model.feature(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.record_batch([batch.column("id"), pa.array(feature, pa.float64()), pa.array(model.scores(feature), pa.float64())], names=["id", "feature", "score"])

    return run


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, held_out, score, predicted, feature)."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "id long, feature double, score double")
    return out.select(F.col("id").alias(id_col), held_out(model.how, "id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "feature")
