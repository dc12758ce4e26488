"""Removal of word windows that also start in an earlier document, behind a count-min prefilter.

Documents are dealt into buckets by a hash of their id, window hashes into shards by their own
bits. Two exchanges of the same shape follow; each moves one packed message for each bucket and
shard that have something to say to each other:

1. Prefilter. A bucket sends each shard a sparse count-min sketch of its windows: for each of the
   two counter rows the sorted counter numbers, delta-coded in byte planes under zstandard, with a
   bit for counts above one. A shard adds up the sketches of all buckets and answers, bit by bit,
   which counters reach two. A window is a candidate if all its counters do. Sketches only
   overestimate, so no repeated window is lost.
2. Exact pass. A bucket sends the 96-bit fingerprint of each distinct candidate with the smallest
   document it starts in; a shard groups equal fingerprints and answers for which of them a smaller
   document exists elsewhere.

A bucket then removes the words covered by such windows. Windows are judged on the input text.

Scale: what a bucket or a shard holds is bounded by its size, whatever the data look like: a window
that occurs a million times is one entry in the message of a bucket. Sizes grow with the square
root of the input, which keeps the number of messages in proportion to the input, up to GROWTH times
(256 MB of text a bucket, a sketch of 256 MB a shard, from 4 TB of text on); beyond that there are
more of them and messages get shorter, to some 170 windows each at 100 TB. The texts are shuffled
once; the three passes over a bucket read the same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Windows, mix64, pieces, word_lists
from .scratch import arrow_batches

ROWS = 2
GROWTH = 32
_ROW_SALTS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass(frozen=True)
class Repeats:
    """window: words. bucket_bytes, shard_windows: least sizes of a bucket and a shard."""

    window: int = 50
    bucket_bytes: int = 8 << 20
    shard_windows: int = 2 << 20
    growth_from: int = 4 << 30  # bytes of text from which buckets and shards grow


@dataclass(frozen=True)
class _Plan:
    window: int
    buckets: int
    shards: int
    width: int  # counters of a shard's sketch in each row, a power of two

    @classmethod
    def of(cls, how: Repeats, n_bytes: int) -> _Plan:
        larger = min(max(1.0, math.sqrt(n_bytes / how.growth_from)), float(GROWTH))
        windows = how.shard_windows * larger
        # English and most other texts have about six bytes a word; a shard may hold more
        return cls(
            how.window,
            max(1, math.ceil(n_bytes / (how.bucket_bytes * larger))),
            max(1, math.ceil(n_bytes / 6 / windows)),
            1 << math.ceil(math.log2(4 * windows)),
        )


def _pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending uint32 numbers as zstandard-compressed byte planes of their differences."""
    delta = np.diff(numbers, prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _bits(flags: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(flags).tobytes(), 1)


def _unbits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(packed), np.uint8), count=n).astype(bool)


def _shard_of(hashes: np.ndarray, plan: _Plan) -> np.ndarray:
    return ((hashes >> np.uint64(34)) % np.uint64(plan.shards)).astype(np.int64)


def _counters(hashes: np.ndarray, row: int, plan: _Plan) -> np.ndarray:
    return (mix64(hashes ^ _ROW_SALTS[row]) & np.uint64(plan.width - 1)).astype(np.uint32)


def _by_shard(hashes: np.ndarray, plan: _Plan) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of its hashes), for shards that have any."""
    shard = _shard_of(hashes, plan)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(shard[part[0]]), part


class _Bucket:
    """The documents of one bucket, in ascending id order, and their windows."""

    def __init__(self, table: pa.Table, plan: _Plan):
        rows = table.select(["id", "text"]).sort_by([("id", "ascending")]) if table.num_rows else table
        self.plan = plan
        self.ids = rows.column("id").to_pylist()
        self.texts = [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]

    def windows(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By pieces: documents, bounds of their words, window starts, both hashes of the windows.

        Documents without an id have no windows: no order puts them before or behind another.
        """
        roll = Windows(self.plan.window)
        for part in pieces(self.texts):
            value, bounds = word_lists(self.texts[part])
            last = np.repeat(bounds[1:], np.diff(bounds))
            known = np.repeat(np.array([x is not None for x in self.ids[part]]), np.diff(bounds))
            start = np.flatnonzero((np.arange(len(value)) + self.plan.window <= last) & known)
            yield part, bounds, start, roll.of(value, 0)[start], (roll.of(value, 1)[start] >> np.uint64(32)).astype(np.uint32)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window hashes of the bucket and how often each occurs."""
        found = [np.unique(x[3], return_counts=True) for x in self.windows()]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        every, many = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        if len(found) == 1:
            return every, many
        order = np.argsort(every)
        every, many = every[order], many[order]
        begin = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1))) if len(every) else np.zeros(0, np.int64)
        return every[begin], np.add.reduceat(many, begin) if len(begin) else many


_SKETCH = "shard long, bucket long, counters array<binary>, repeated array<binary>"
_ANSWER = "bucket long, shard long, exact boolean, bits array<binary>"
_CLAIM = "shard long, bucket long, docs binary, counts binary, prints binary"


def _sketch(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        hashes, many = _Bucket(table, plan).distinct()
        out = []
        for shard, part in _by_shard(hashes, plan):
            counters, repeated = [], []
            for row in range(ROWS):
                number = _counters(hashes[part], row, plan)
                order = np.argsort(number)
                number, count = number[order], many[part][order]
                begin = np.flatnonzero(np.diff(number, prepend=number[0] + np.uint32(1)))
                counters.append(_pack_sorted(number[begin]))
                repeated.append(_bits(np.add.reduceat(count, begin) > 1))
            out.append((shard, bucket, counters, repeated))
        return _rows(out, [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())], ["shard", "bucket", "counters", "repeated"])

    return run


def _rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=names)


def _merge(plan: _Plan):
    """A shard's sum of all sketches, and its answers to the buckets."""

    def run(table: pa.Table) -> pa.Table:
        shard, buckets = table.column("shard")[0].as_py(), table.column("bucket").to_pylist()
        counters, repeated = table.column("counters").to_pylist(), table.column("repeated").to_pylist()
        answers: list[list[bytes]] = [[] for _ in buckets]
        for row in range(ROWS):
            total = np.zeros(plan.width, np.uint8)  # counts up to two are enough
            for numbers, flags in zip(counters, repeated, strict=True):
                at = _unpack_sorted(numbers[row])
                total[at] = np.minimum(total[at] + 1 + _unbits(flags[row], len(at)), 2)
            for k, numbers in enumerate(counters):
                answers[k].append(_bits(total[_unpack_sorted(numbers[row])] > 1))
        rows = [(b, shard, False, x) for b, x in zip(buckets, answers, strict=True)]
        return _rows(rows, [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.binary())], ["bucket", "shard", "exact", "bits"])

    return run


class _Candidates:
    """What a bucket knows after the prefilter: which of its windows may be repeated."""

    def __init__(self, bucket: _Bucket, answers: dict[int, list[bytes]], plan: _Plan):
        self.bucket, self.plan = bucket, plan
        hashes, _ = bucket.distinct()
        maybe = np.zeros(len(hashes), dtype=bool)
        for shard, part in _by_shard(hashes, plan):
            reach = np.ones(len(part), dtype=bool)
            for row in range(ROWS):
                known, place = np.unique(_counters(hashes[part], row, plan), return_inverse=True)
                reach &= _unbits(answers[shard][row], len(known))[place]
            maybe[part] = reach
        self.hashes = hashes[maybe]

    def windows(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As _Bucket.windows(), candidates only."""
        for part, bounds, start, first, second in self.bucket.windows():
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, first), len(self.hashes) - 1)
                hit = self.hashes[at] == first
            else:
                hit = np.zeros(len(first), dtype=bool)
            yield part, bounds, start[hit], first[hit], second[hit]

    def claims(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, document): the distinct candidates in a fixed order, with the smallest document of each."""
        first, second, doc = [], [], []
        for part, bounds, start, a, b in self.windows():
            # by document in ascending order: the first of equals has the smallest
            ids = np.array([x if x is not None else 0 for x in self.bucket.ids[part]], dtype=np.int64)
            first.append(a), second.append(b), doc.append(ids[np.searchsorted(bounds, start, side="right") - 1])
        if not first:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        a, b, d = np.concatenate(first), np.concatenate(second), np.concatenate(doc)
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new], d[new]


def _answers(table: pa.Table, exact: bool) -> dict[int, list[bytes]]:
    rows = zip(table.column("shard").to_pylist(), table.column("exact").to_pylist(), table.column("bits").to_pylist(), strict=True)
    return {shard: bits for shard, is_exact, bits in rows if is_exact == exact}


def _claim(plan: _Plan):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and replies.num_rows:
            bucket = docs.column("bucket")[0].as_py()
            a, b, d = _Candidates(_Bucket(docs, plan), _answers(replies, False), plan).claims()
            for shard, part in _by_shard(a, plan):
                part = part[np.argsort(d[part], kind="stable")]
                ids, counts = np.unique(d[part], return_counts=True)
                prints = a[part].astype("<u8").tobytes() + b[part].astype("<u4").tobytes()
                out.append((shard, bucket, ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), prints))
        return _rows(out, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["shard", "bucket", "docs", "counts", "prints"])

    return run


def _settle(plan: _Plan):
    """A shard's exact groups: for each claim, whether a smaller document claims the same window."""

    def run(table: pa.Table) -> pa.Table:
        shard, buckets = table.column("shard")[0].as_py(), table.column("bucket").to_pylist()
        first, second, doc = [], [], []
        for docs, counts, prints in zip(*(table.column(x).to_pylist() for x in ("docs", "counts", "prints")), strict=True):
            n = len(prints) // 12
            first.append(np.frombuffer(prints, "<u8", n))
            second.append(np.frombuffer(prints, "<u4", n, offset=8 * n))
            doc.append(np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4")))
        sizes = [len(x) for x in doc]
        a, b, d = np.concatenate(first), np.concatenate(second), np.concatenate(doc)
        order = np.lexsort((b, a))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        begin = np.flatnonzero(new)
        least = np.empty(len(a), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(d[order], begin), np.diff(np.append(begin, len(a))))
        earlier = np.split(least < d, np.cumsum(sizes)[:-1])
        rows = [(x, shard, True, [_bits(y)]) for x, y in zip(buckets, earlier, strict=True)]
        return _rows(rows, [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.binary())], ["bucket", "shard", "exact", "bits"])

    return run


def _remove(plan: _Plan):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        bucket = _Bucket(docs, plan)
        ids, words, removed, kept = bucket.ids, [], [], []
        found = _Candidates(bucket, _answers(replies, False), plan)
        a, b, d = found.claims()
        earlier = np.zeros(len(a), dtype=bool)
        settled = _answers(replies, True)
        for shard, part in _by_shard(a, plan):
            part = part[np.argsort(d[part], kind="stable")]
            earlier[part] = _unbits(settled[shard][0], len(part))
        least = np.where(earlier, np.iinfo(np.int64).min, d)  # the smallest document known for a window
        for part, bounds, start, first, second in found.windows():
            own = np.array([x if x is not None else 0 for x in ids[part]], dtype=np.int64)
            here = np.searchsorted(a, first)
            while (odd := b[here] != second).any():  # equal first hashes lie side by side
                here = here + odd
            gone = start[least[here] < own[np.searchsorted(bounds, start, side="right") - 1]]
            edge = np.zeros(bounds[-1] + plan.window + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + plan.window, -1)
            keep = np.cumsum(edge)[: bounds[-1]] == 0
            for text, begin, end in zip(bucket.texts[part], bounds[:-1], bounds[1:], strict=True):
                mask = keep[begin:end]
                left = text.split() if mask.all() else [w for w, k in zip(text.split(), mask.tolist(), strict=True) if k]
                words.append(int(end - begin)), removed.append(int(end - begin) - len(left)), kept.append(b" ".join(left))
        return pa.table([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, how: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, n_words, n_removed, text), the kept words joined by one space.

    A word goes if a window that covers it also starts in a document of a smaller id. Null and
    empty texts have no words. Rows with a null id are returned whole and take nothing from others.
    Rows that repeat an id are one document: they take nothing from each other, and each is
    returned. Texts shorter than a window are returned whole. Other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = _Plan.of(how, n_bytes)
    dealt = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    source = source.withColumn("bucket", F.pmod(dealt, F.lit(plan.buckets).cast("long"))).repartition("bucket")

    sketches = source.groupBy("bucket").applyInArrow(_sketch(plan), _SKETCH)
    counted = sketches.groupBy("shard").applyInArrow(_merge(plan), _ANSWER)
    claims = source.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_claim(plan), _CLAIM)
    settled = claims.groupBy("shard").applyInArrow(_settle(plan), _ANSWER)
    replies = counted.union(settled)
    out = source.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_remove(plan), "id long, n_words long, n_removed long, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "text")
