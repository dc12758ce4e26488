"""Phrases of two to four words that occur often, scored by how often their parts occur without them.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at blanks and tabs into
words; phrases lie within a piece. Everything is counted by language (null: ``und``); nulls count as
empty texts. A phrase is a candidate from ``least`` occurrences on.

1. Words are counted with built-in functions. The frequent ones get numbers, a word of two languages
   two of them, and go out as a double-array trie of language and word, with which tasks turn texts
   into numbers, 0 for what no candidate may hold: a rare word or the end of a piece.
2. For 2, 3 and 4 words: a window is Apriori-safe if its first and its last words, all but one, are a
   frequent phrase. Tasks add safe windows up in buckets of their hash, up to ``least`` each, and
   merge their counts; a window whose bucket stays below ``least`` cannot be frequent. The others'
   distinct windows are the candidates: buckets overestimate, so none is lost.
3. Candidates are dealt into blocks of bounded size, ranges of their order. Each is made a double-array trie and broadcast;
   numpy walks it from all places of the texts whose word a phrase of the block begins with at once,
   level by level, and counts the accepting states with bincount. The counts of all tasks are summed and those from ``least`` on stay. They are
   exact, and only they are used from here on.

A broadcast trie has at most ``block`` entries, that of words twice as many, and a bitmap of buckets
at most 2**29 bits, whatever the corpus; what is bounded so is paid with passes over the numbers, one
for each block of frequent words, of candidates and of phrases at each size. Passes read all numbers;
their walks together are those of one. Where more windows come than buckets can tell
apart, buckets let more candidates through, and blocks grow in number; results stay exact.

A cut after the first k words has l = occurrences of the first part, r = of the rest and the score
floor(2000000 * a / (l + r)); the lowest counts, ties to the smallest k. A candidate goes if it lies
in a longer one, itself gone or not, that has at least 80 % of its occurrences. Repeated rows are
counted again, an empty table gives no rows, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .double_array import DIGIT, DoubleArray, build, digits_of
from .kernels import BLOCK, _blocks, mix64
from .scratch import Scratch

_KINDS = np.zeros(256, np.uint8)  # of bytes: 0 in words, 1 blank, 2 end of a piece
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[.,;:!?\x0A-\x0D\x20\x09]+"
FLUSH = 1 << 20  # windows that a task holds before it passes them on
MOST_BUCKETS = 29  # bits
LEAST_BUCKETS = 16
FEW_ROWS = {"parquet.block.row.count.limit": "16"}  # a row has the texts of a batch; Spark's reader holds what a row group has of up to 4,096 rows at once


@dataclass(frozen=True)
class Mining:
    """least: occurrences of a candidate; longest: words; block: entries of a broadcast trie; top: rows of a language; within: percent of a candidate's occurrences from which a longer one covers it."""

    least: int = 30
    longest: int = 4
    block: int = 500_000
    top: int = 2000
    within: int = 80


def coded(texts: list[bytes], trie: DoubleArray, numbers: np.ndarray, root: int) -> tuple[np.ndarray, int]:
    """(numbers, words) of texts of one language: the numbers of known words, 0 for other words and between pieces, in their order."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    out, n = [np.zeros(0, np.int32)], 0
    for _, block in _blocks(flat, BLOCK):
        block = _LOWER[block]
        kind = _KINDS[block]
        solid = np.zeros(len(block) + 2, np.int8)
        solid[1:-1] = kind == 0
        turn = np.flatnonzero(np.diff(solid))
        start, end = turn[0::2], turn[1::2]
        ends = np.concatenate([[0], np.cumsum(kind == 2)])
        gap = np.diff(ends[start], prepend=0) > 0
        place = np.arange(len(start)) + np.cumsum(gap)
        ids = np.zeros(len(start) + int(gap.sum()) + 1, np.int32)  # one more for what ends the last piece
        if root >= 0 and len(start):
            found = trie.strings(block, start, end, root)
            ids[place] = np.where(found >= 0, numbers[found], 0)
        trail = ends[-1] > (ends[start[-1]] if len(start) else 0)
        out.append(ids if trail else ids[:-1])
        n += len(start)
    return np.concatenate(out), n


def _coding(words: Broadcast, again: bool, last: bool):
    """Texts to numbers, one row for each language of a batch. again: rows have numbers already, which stay; last: texts go."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, numbers = words.value
        for batch in batches:
            lang, text = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            if again:
                groups = [(y, [t], np.frombuffer(i, "<i4")) for y, t, i in zip(lang, text, batch.column("ids").to_pylist(), strict=True)]
            else:
                groups = [(name, [t for y, t in zip(lang, text, strict=True) if y == name], 0) for name in dict.fromkeys(lang)]
            for name, texts, known in groups:
                ids, n = coded(texts, trie, numbers, trie.after(name.encode() + b"\xff"))
                yield pa.record_batch([[name], [n], [np.maximum(ids, known).astype("<i4").tobytes()], pa.array([None if last else b"\n".join(texts)], pa.binary())], schema=schema)

    return run


Span = tuple[int, int] | None  # from and to which first number a block's phrases go; None: all


def _safe(ids: np.ndarray, trie: DoubleArray | None, span: Span, size: int, digits: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, first parts) of windows of ``size`` numbers whose parts of size - 1 are phrases of ``trie``; of words for pairs.

    A first part is told by its place in the trie, or by its word. whole: the trie has all phrases, so
    the last part can be told as well as the first.
    """
    if size == 2:
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        return at, ids[at]
    if not whole:
        at, hit = trie.places(ids[:-1], size - 1, digits, span)
        ok = (hit >= 0) & (ids[at + size - 1] > 0)
        return at[ok], hit[ok]
    hit = trie.windows(ids, size - 1, digits)
    ok = (hit[: len(ids) - size + 1] >= 0) & (ids[size - 1 :] > 0)
    at = np.flatnonzero(ok & (hit[1 : len(ids) - size + 2] >= 0))
    return at, hit[at]


def _hashed(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = mix64((h + np.uint64(0x9E3779B97F4A7C15)) ^ ids[at + k].astype(np.uint64))
    return h


def _windows(batches: Iterator[pa.RecordBatch], trie: Broadcast | None, span: Span, size: int, digits: int, whole: bool, bits: int, often: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Buckets of about FLUSH safe windows at a time; with a bitmap ``often`` only windows whose bucket is set, also an exact key of each and its numbers."""
    held, rows = [], 0
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            ids = np.frombuffer(blob, "<i4")
            if len(ids) < size:
                continue
            every, first = _safe(ids, trie.value if trie else None, span, size, digits, whole)
            for k in range(0, len(every), FLUSH):
                at, own = every[k : k + FLUSH], first[k : k + FLUSH]
                bucket = (_hashed(ids, at, size) >> np.uint64(64 - bits)).astype(np.int64)
                if often is None:
                    held.append((bucket,))
                else:
                    kept = np.flatnonzero((often[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1)
                    bucket, at, own = bucket[kept], at[kept], own[kept]
                    held.append((bucket, own.astype(np.int64) << 32 | ids[at + size - 1], np.stack([ids[at + j] for j in range(size)], 1)))
                rows += len(bucket)
                if rows >= FLUSH:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _slices(bits: int) -> int:
    """Bits of the number of slices that buckets are dealt in."""
    return max(4, bits - 20)


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts, as planes of bytes of the steps between places and of the counts."""
    return np.concatenate([np.diff(places, prepend=0), counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(both[: len(both) // 2], dtype=np.int64), both[len(both) // 2 :]


def _bucketed(trie, span, size, digits, whole, bits, least):
    """Counts of safe windows by bucket, up to ``least``, a row for each slice of the buckets that was met."""
    schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
    low = bits - _slices(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for (bucket,) in _windows(batches, trie, span, size, digits, whole, bits):
            part = int(bucket[0] + len(bucket)) if len(bucket) else 0
            bucket, counts = np.unique(bucket, return_counts=True)
            bounds = np.searchsorted(bucket, np.arange((1 << (bits - low)) + 1) << low)
            met = np.flatnonzero(np.diff(bounds))
            blobs = [packer.compress(_packed(bucket[bounds[k] : bounds[k + 1]] - (k << low), np.minimum(counts[bounds[k] : bounds[k + 1]], least))) for k in met]
            yield pa.record_batch([pa.array(met, pa.int32()), pa.array((part + met) & 31, pa.int32()), blobs], schema=schema)  # parts spread a slice's counts over tasks

    return run


def _summed(most: int | None, low: int = 0, bits_of: int | None = None):
    """Adds up the counts of rows that follow each other with one slice and part.

    most: rows have places (see _packed) among 2**low, and sums go up to ``most``; else counts of all
    places. bits_of: gives a bit a count, whether it reaches this.
    """
    schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        packer, reader = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def out() -> pa.RecordBatch:
            if bits_of is not None:
                blob = np.packbits(total >= bits_of, bitorder="little").tobytes()
            elif most:
                met = np.flatnonzero(total)
                blob = packer.compress(_packed(met, total[met]))
            else:
                blob = packer.compress(total.astype("<i8").tobytes())
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), [blob]], schema=schema)

        for batch in batches:
            for k, part, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "counts")), strict=True):
                blob = reader.decompress(blob)
                if most:
                    places, counts = _unpacked(blob)
                else:
                    counts = np.frombuffer(blob, "<i8")
                if (k, part) != key:
                    if key is not None:
                        yield out()
                    key, total = (k, part), np.zeros(1 << low if most else len(counts), np.int64)
                if most:
                    total[places] = np.minimum(total[places] + counts, most)
                else:
                    total += counts
        if key is not None:
            yield out()

    return run


def _added(rows: DataFrame, most: int | None, low: int = 0, bits_of: int | None = None) -> DataFrame:
    """(slice, counts): counts summed by slice and part, then by slice, so that no task adds up what all others counted."""
    kind = "slice int, part int, counts binary"
    dealt = lambda df: df.repartition("slice", "part").sortWithinPartitions("slice", "part")
    first = dealt(rows).mapInArrow(_summed(most, low), kind).withColumn("part", F.lit(0))
    return dealt(first).mapInArrow(_summed(most, low, bits_of), kind).select("slice", "counts")


def _proposed(trie, span, size, digits, whole, bits, often: Broadcast):
    """The distinct safe windows of a task whose bucket came often, packed by slice of their buckets."""
    schema = pa.schema([("slice", pa.int32()), ("windows", pa.binary())])
    low = bits - _slices(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for bucket, key, rows in _windows(batches, trie, span, size, digits, whole, bits, often.value):
            keep = np.unique(key, return_index=True)[1]
            keep = keep[np.argsort(bucket[keep], kind="stable")]
            bounds = np.searchsorted(bucket[keep], np.arange((1 << (bits - low)) + 1) << low)
            for k in np.flatnonzero(np.diff(bounds)):
                part = rows[keep[bounds[k] : bounds[k + 1]]].astype("<i4")
                yield pa.record_batch([pa.array([k], pa.int32()), [packer.compress(part.tobytes())]], schema=schema)

    return run


def _distinct(size: int):
    """The distinct windows of rows that follow each other with one slice."""
    names = [f"w{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, held, more, n = zstandard.ZstdDecompressor(), None, np.zeros(0, f"V{4 * size}"), [], 0

        def merged() -> np.ndarray:
            return np.unique(np.concatenate([held, *more])) if more else held

        def out() -> Iterator[pa.RecordBatch]:
            held = merged()
            rows = np.frombuffer(held.tobytes(), "<i4").reshape(-1, size)
            for k in range(0, len(rows), 1 << 16):
                yield pa.record_batch([pa.array(rows[k : k + (1 << 16), j], pa.int32()) for j in range(size)], names=names)

        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                if k != at:
                    yield from out()
                    at, held, more, n = k, held[:0], [], 0
                more.append(np.frombuffer(reader.decompress(blob), held.dtype))
                n += len(more[-1])
                if n > max(len(held), FLUSH >> 2):  # so that what is held is not sorted again for every row
                    held, more, n = merged(), [], 0
        yield from out()

    return run


PHRASES = 1 << 14  # phrases whose counts are one row


def _counted(trie: Broadcast, span: Span, n: int, size: int, digits: int):
    """How often a task's texts hold each of the ``n`` phrases of a trie, a row for each slice of them that was met."""
    schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, rows = np.zeros(n, np.int64), [], 0
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                ids = np.frombuffer(blob, "<i4")
                for at in range(0, len(ids), FLUSH):  # a stretch and what its last windows need of the next one
                    hit = trie.value.places(ids[at : at + FLUSH + size - 1], size, digits, span)[1]
                    held.append(hit[hit >= 0])
                    rows += len(held[-1])
                    if rows >= FLUSH:
                        total += np.bincount(np.concatenate(held), minlength=n)
                        held, rows = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n)
        packer, part = zstandard.ZstdCompressor(level=1), int(total.sum()) & 31  # spreads a slice's counts over tasks
        for k in range(0, n, PHRASES):
            if total[k : k + PHRASES].any():
                yield pa.record_batch([pa.array([k // PHRASES], pa.int32()), pa.array([part], pa.int32()), [packer.compress(total[k : k + PHRASES].astype("<i8").tobytes())]], schema=schema)

    return run


def _spelled(phrases: Broadcast, size: int, least: int):
    """The phrases whose summed counts reach ``least``."""
    names = [f"w{k}" for k in range(size)] + ["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(reader.decompress(blob), "<i8")
                often = np.flatnonzero(n >= least)
                rows = phrases.value[k * PHRASES + often]
                yield pa.record_batch([*(pa.array(rows[:, j], pa.int32()) for j in range(size)), pa.array(n[often])], names=names)

    return run


class _Miner:
    def __init__(self, docs: DataFrame, how: Mining, text_col: str, lang_col: str):
        self.spark, self.how = docs.sparkSession, how
        self.scratch = Scratch(self.spark, "collocations")
        self.docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def blocks(self, table: DataFrame, rows: int, most: int) -> Iterator[pa.Table]:
        """``table``, of ``rows`` counted rows, in blocks of ``most`` rows, in the order of its columns."""
        if rows <= most:
            yield from [table.toArrow()] if rows else []
            return
        dealt = self.scratch.save(numbered(table, table.columns, "_row"), "numbered")
        for k in range(-(-rows // most)):
            yield dealt.filter((F.col("_row") > k * most) & (F.col("_row") <= (k + 1) * most)).select(*table.columns).toArrow()
        self.scratch.drop(dealt)

    def words(self) -> DataFrame:
        """(lang, word, id, a): frequent words by number."""
        every = self.docs.select("lang", F.explode(F.split("text", _BREAKS)).alias("word")).filter("word <> ''")
        written = every.groupBy("lang", "word").agg(F.count("*").alias("a"))  # words are lower-cased once, not at each place
        lower = F.translate("word", _UPPER_CASE, _LOWER_CASE).alias("word")
        often = written.select("lang", lower, "a").groupBy("lang", "word").agg(F.sum("a").alias("a")).filter(F.col("a") >= self.how.least)
        return self.scratch.save(numbered(often, ["lang", "word"], "id").select("lang", "word", F.col("id").cast("int").alias("id"), "a"), "words")

    def numbers(self, words: DataFrame, rows: int) -> DataFrame:
        """(lang, n, ids): the texts as numbers, and how many words they have."""
        table, most, last = self.docs, 2 * self.how.block, None  # a pass writes all texts again, so blocks are larger here
        n = -(-rows // most)
        for k, block in enumerate(self.blocks(words.select("lang", "word", "id"), rows, most)):
            keys = [y.encode() + b"\xff" + w.encode() for y, w in zip(block["lang"].to_pylist(), block["word"].to_pylist(), strict=True)]
            trie = build(np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int64))
            sent = self.spark.sparkContext.broadcast((trie, block["id"].to_numpy().astype(np.int32)))
            table = self.scratch.save(table.mapInArrow(_coding(sent, k > 0, k == n - 1), "lang string, n long, ids binary, text binary"), "numbers", **FEW_ROWS)
            sent.destroy()
            if last is not None:
                self.scratch.drop(last)
            last = table
        return table.select("lang", "n", "ids")

    def tries(self, table: DataFrame, rows: int, size: int, digits: int) -> Iterator[tuple[Broadcast, Span, Broadcast]]:
        """(trie, span, phrases) of each block of ``table`` (w0, ..., of ``size`` numbers), broadcast while the caller is at it.

        Blocks are ranges, so that a task walks a block's trie from the places of its first numbers only:
        the walks of all blocks together are those of one trie.
        """
        for block in self.blocks(table.select(*[f"w{k}" for k in range(size)]), rows, self.how.block):
            phrases = np.stack([block[f"w{k}"].to_numpy() for k in range(size)], 1).astype(np.int32)
            span = (int(phrases[:, 0].min()), int(phrases[:, 0].max())) if rows > self.how.block else None
            sent = tuple(self.spark.sparkContext.broadcast(x) for x in (build(*digits_of(phrases, digits)), phrases))
            yield sent[0], span, sent[1]
            for x in sent:
                x.destroy()

    def often(self, tables: list[DataFrame], bits: int) -> np.ndarray:
        """A bit for each bucket: whether its counts reach ``least``."""
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.union(table)
        bitmap, low = np.zeros(1 << bits >> 3, np.uint8), bits - _slices(bits)
        size = 1 << low >> 3
        for r in _added(rows, self.how.least, low, self.how.least).collect():
            bitmap[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.counts, np.uint8)
        return bitmap

    def phrases(self, numbers: DataFrame, before: DataFrame, rows: int, windows: int, size: int, digits: int) -> DataFrame:
        """(w0, ..., a): the frequent phrases of ``size`` words; before: the ``rows`` frequent ones of a word less, which come ``windows`` times."""
        names, least = [f"w{k}" for k in range(size)], self.how.least
        bits = min(MOST_BUCKETS, max(LEAST_BUCKETS, (windows // 2).bit_length()))
        whole = rows <= self.how.block
        rounds = lambda: iter([(None, None, None)]) if size == 2 else self.tries(before, rows, size - 1, digits)
        counts = [self.scratch.save(numbers.select("ids").mapInArrow(_bucketed(trie, span, size, digits, whole, bits, least), "slice int, part int, counts binary"), "buckets") for trie, span, _ in rounds()]
        often = self.spark.sparkContext.broadcast(self.often(counts, bits))
        self.scratch.drop(*counts)
        found = []
        for trie, span, _ in rounds():
            packed = numbers.select("ids").mapInArrow(_proposed(trie, span, size, digits, whole, bits, often), "slice int, windows binary")
            packed = packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_distinct(size), ", ".join(f"{x} int" for x in names))
            found.append(self.scratch.save(packed, "candidates"))
        often.destroy()
        candidates = found[0]
        for table in found[1:]:
            candidates = candidates.union(table)
        if not whole and size > 2:
            candidates = candidates.join(before.select(*[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(size - 1)]), names[1:], "left_semi").select(*names)
            candidates = self.scratch.save(candidates, "candidates")
        out = []
        for trie, span, rows_ in self.tries(candidates, candidates.count(), size, digits):
            counts = numbers.select("ids").mapInArrow(_counted(trie, span, len(rows_.value), size, digits), "slice int, part int, counts binary")
            spelled = _added(counts, None).mapInArrow(_spelled(rows_, size, least), ", ".join(f"{x} int" for x in names) + ", a long")
            out.append(self.scratch.save(spelled, "phrases"))
        table = out[0] if out else candidates.withColumn("a", F.lit(0).cast("long")).limit(0)
        for more in out[1:]:
            table = table.union(more)
        return table


def scored(phrases: DataFrame, within: int) -> DataFrame:
    """Candidates (w, a, l, r, score) of the frequent phrases (w array, a), single words among them, that no longer one covers."""
    size = F.size("w")
    candidates = phrases.filter(size > 1)
    cut = candidates.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("*", F.slice("w", 1, F.col("k")).alias("first"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cut = cut.join(phrases.select(F.col("w").alias("first"), F.col("a").alias("l")), "first").join(phrases.select(F.col("w").alias("rest"), F.col("a").alias("r")), "rest")
    score = F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    least = cut.groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("w", "a", "x.l", "x.r", "x.score")
    inside = candidates.filter(size > 2).select(F.col("a").alias("longer"), "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("n"))
    inside = inside.select("longer", "n", "w", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("at")).select(F.slice("w", F.col("at"), F.col("n")).alias("w"), "longer")
    longest = inside.groupBy("w").agg(F.max("longer").alias("longer"))
    return least.join(longest, "w", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within)).drop("longer")


def collocations(docs: DataFrame, how: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score and occurrences, the highest first, then by phrase."""
    miner = _Miner(docs, how, text_col, lang_col)
    words = miner.words()
    rows, windows, highest = words.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    every = words.select(F.array("id").alias("w"), "a")
    if rows:
        numbers, digits = miner.numbers(words, rows), max(1, -(-int(highest).bit_length() // DIGIT))
        total = numbers.groupBy("lang").agg(F.sum("n").alias("n"))
        before = words.select(F.col("id").alias("w0"), "a")
        for size in range(2, how.longest + 1):
            before = miner.phrases(numbers, before, rows, windows, size, digits)
            rows, windows = before.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0))).first()
            if not rows:
                break
            every = every.union(before.select(F.array(*[f"w{k}" for k in range(size)]).alias("w"), "a"))
    else:
        total = words.select("lang", F.col("a").alias("n"))
    best = miner.scratch.save(scored(every, how.within), "scored")
    spelled = best.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("w").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = best.join(spelled, "w").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= how.top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
