"""Passages of benchmark items in documents, up to a share of edited words.

Texts are sequences of words (lower-case letters and digits). Finding an item takes three steps:

1. Prefilter. An edit changes at most RUN of an item's n - RUN + 1 runs of RUN words, so a passage
   with up to t edits keeps n - RUN + 1 - RUN * t of them, within n + t words. Stretches of a document
   that keep fewer are skipped; no passage within the allowed edits is lost by that.
2. CGK walks with bit-sampling LSH. Windows of about the size that t edits must leave of the item,
   however long it is, are embedded by random walks, from every word of the stretch and from every
   word of the item (of an item of n words: from every (1 + n // GRID)-th): a walk writes the word
   it stands on at every step, and moves on by a random bit that depends on the step and that word. Two windows a few edits apart read mostly the same words at the same steps
   after the walks have met again, so edit distance becomes Hamming distance of what is written. Of
   each walk a few steps are sampled. A stretch is a candidate if, in one repetition, a window of it
   agrees in all samples with one of the item; repetitions follow from the target recall.
   With ``runs`` off, step 1 is left out and walks start at every word of every text: the same search
   at some hundred times the cost, against which step 1 can be held.
3. Candidates are verified by the exact edit distance of the whole item to the best part of the stretch.

Documents stay where they are read. The items are a stated query set: they are collected in blocks
of bounded size, and each block is held against all documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, pieces, word_lists
from .scratch import arrow_batches

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GRID = 512  # words of an item from which its windows begin at every second, third, ... word
RUN = 3  # words of a run; shorter where so many edits are allowed that no run of this length must be left
WINDOWS = 1024  # windows embedded at a time
HITS = 1 << 20  # runs found held at a time, or those of one text
_PAD = np.uint64(0x8F4C7E21A3D5B969)


@dataclass(frozen=True)
class Decontamination:
    """percent: edits allowed, of an item's words. samples: steps that must agree in a repetition.

    agree: share of a walk's steps on which the best windows of passages worth finding agree at
    least; with it, the repetitions follow from recall. block_bytes: text of items held at a time.
    runs: whether walks are made only in stretches that keep enough runs of words.
    """

    percent: int = 20
    samples: int = 3
    agree: float = 0.5
    recall: float = 0.99
    block_bytes: int = 2 << 20
    runs: bool = True
    seed: int = 4242

    @property
    def repetitions(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agree**self.samples))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_lists([x.translate(_PLAIN) for x in texts])


def _windows(n: int, edits: int) -> tuple[int, list[int]]:
    """Window size for an item of ``n`` words, a power of two or three halves of one, and the words its windows begin at."""
    power = 1 << (max(1, n - edits).bit_length() - 1)
    size = power * 3 // 2 if 1 < power * 3 // 2 <= n - edits else power
    return size, sorted({*range(0, n - size + 1, 1 + n // GRID), n - size})


def _run(n: int, edits: int) -> tuple[int, int]:
    """Words of a run, and the runs that are left of an item of ``n`` words after ``edits``."""
    for q in range(RUN, 1, -1):
        if n - q + 1 - q * edits > 0:
            return q, n - q + 1 - q * edits
    return 1, max(n - edits, 1)


def _runs(value: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` words from each word on."""
    n = max(len(value) - q + 1, 0)
    out = np.full(n, q, np.uint64)
    for k in range(q):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + value[k : k + n])
    return out


class Walks:
    """The repetitions of one window size: a seed and sampled steps each."""

    def __init__(self, size: int, how: Decontamination):
        rng = np.random.default_rng((how.seed, size))
        n = min(how.samples, 2 * size)
        self.size = size
        self.seeds = rng.integers(1, 1 << 62, how.repetitions).astype(np.uint64)
        steps = np.stack([np.sort(rng.choice(2 * size, n, replace=False)) for _ in range(how.repetitions)])
        self.last = int(steps.max())
        self.taken = [np.flatnonzero((steps == j).any(axis=1)) for j in range(self.last + 1)]

    def keys(self, window: np.ndarray) -> np.ndarray:
        """As ``along``, for each row of words."""
        return self.along(window.ravel(), np.arange(len(window)) * self.size)

    def along(self, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hash of the repetition and of what its walk writes at its steps, for the window at each of ``starts``, ascending: (windows, repetitions)."""
        out = [self._keys(value, starts[k : k + WINDOWS]) for k in range(0, len(starts), WINDOWS)]
        return np.concatenate(out) if out else np.zeros((0, len(self.seeds)), np.uint64)

    def _keys(self, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # the words under the windows, each once: windows overlap
        many, size = len(self.seeds), self.size
        fresh = np.minimum(np.diff(starts, prepend=starts[0] - size), size)
        ends = np.cumsum(fresh)
        flat = value[np.repeat(starts + size - ends, fresh) + np.arange(ends[-1])]
        base = (ends - size)[:, None]
        at = np.zeros((len(starts), many), np.int64)
        out = np.repeat(self.seeds[None, :], len(starts), axis=0)
        which = np.arange(many)
        for j in range(self.last + 1):
            if j % 64 == 0:  # the bits of 64 steps
                bits = mix64(flat[:, None] ^ mix64(self.seeds + np.uint64(j))).ravel()
            inside = base + np.minimum(at, size - 1)
            if len(own := self.taken[j]):
                word = np.where(at[:, own] < size, flat[inside[:, own]], _PAD)
                out[:, own] = mix64(out[:, own] * np.uint64(31) + word)
            if j < self.last:
                at += ((bits[inside * many + which] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        return out


class Items:
    """A block of benchmark items and their sampled embeddings, by window size."""

    def __init__(self, rows: list[tuple[int, bytes]], how: Decontamination):
        self.how = how
        rows = sorted(rows)
        value, bounds = _words([x[1] for x in rows])
        self.words: list[np.ndarray] = [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.ids = [x[0] for x in rows]
        self.bags = [Counter(w.tolist()) for w in self.words]
        self.most = [len(w) * how.percent // 100 for w in self.words]
        by_size = defaultdict(list)
        for i, words in enumerate(self.words):
            if len(words):
                size, starts = _windows(len(words), self.most[i])
                by_size[size].append((i, np.array(starts)))
        # of each window size: the walks, the keys of all items' windows in order, and the item of each
        self.size = np.zeros(len(self.words), np.int64)
        self.walks = []
        for size, items in sorted(by_size.items()):
            walks = Walks(size, how)
            keys = np.concatenate([walks.along(self.words[i], x).ravel() for i, x in items])
            item = np.repeat(np.array([i for i, x in items for _ in range(len(x))]), how.repetitions)
            order = np.lexsort((item, keys))
            new = np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(item[order]) != 0)])
            self.walks.append((walks, keys[order][new], item[order][new]))
            self.size[[i for i, _ in items]] = size

        by_run = defaultdict(list)
        for i, words in enumerate(self.words):
            if len(words):
                by_run[_run(len(words), self.most[i])[0]].append(i)
        # of each length of a run: the distinct runs of all items, and the items of each
        self.runs = []
        for q, items in sorted(by_run.items()):
            own = [np.unique(_runs(self.words[i], q)) for i in items]
            keys, item = np.concatenate(own), np.repeat(np.array(items), [len(x) for x in own])
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            self.runs.append((q, distinct, np.append(first, len(keys)), item[order]))
        self.left = np.array([_run(len(w), t)[1] for w, t in zip(self.words, self.most, strict=True)], np.int64)
        self.span = np.array([len(w) + t for w, t in zip(self.words, self.most, strict=True)], np.int64)

    def _places(self, value: np.ndarray, place: np.ndarray, length: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of the stretches that keep enough runs of an item to hold it."""
        for q, distinct, first, items in self.runs:
            got = _runs(value, q)
            at = np.minimum(np.searchsorted(distinct, got), len(distinct) - 1)
            inside = place[: len(got)] + q <= length[owner[: len(got)]]
            where = np.flatnonzero((distinct[at] == got) & inside)
            many = first[at[where] + 1] - first[at[where]]
            total = np.cumsum(many)
            cuts = np.searchsorted(total, np.arange(HITS, int(total[-1]) if len(total) else 0, HITS))
            # cut between texts, so that a passage stays whole
            cuts = np.unique(np.searchsorted(owner[where], owner[where[cuts]])) if len(cuts) else cuts
            for part, n in zip(np.split(where, cuts), np.split(many, cuts), strict=True):
                if not len(part):
                    continue
                word = np.repeat(part, n)
                item = items[np.repeat(first[at[part]], n) + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)]
                order = np.lexsort((word, owner[word], item))
                word, item = word[order], item[order]
                new = np.concatenate([[True], (item[1:] != item[:-1]) | (owner[word[1:]] != owner[word[:-1]])])
                reach = self.span[item] - q
                key = np.cumsum(new) * (2 * len(value) + int(self.span.max()) + 1) + word
                behind = np.searchsorted(key, key + reach, "right")
                dense = behind - np.arange(len(key)) >= self.left[item]
                mark = np.zeros(len(key) + 1, np.int64)
                np.add.at(mark, np.flatnonzero(dense), 1)
                np.add.at(mark, behind[dense], -1)
                kept = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                if not len(kept):
                    continue
                apart = np.flatnonzero(np.diff(key[kept]) > reach[kept[1:]]) + 1
                for some in np.split(kept, apart):
                    i, lo, hi = int(item[some[0]]), int(word[some[0]]), int(word[some[-1]])
                    yield int(owner[lo]), i, lo + q - int(self.span[i]), hi + int(self.span[i])

    def _met(self, value: np.ndarray, walks: Walks, keys: np.ndarray, items: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, starts of windows) that agree in one repetition, without repetitions; ``starts`` ascend."""
        wide = len(value) + 1
        for k in range(0, len(starts), WINDOWS):
            some = starts[k : k + WINDOWS]
            got = walks.along(value, some).ravel()
            lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            met = np.flatnonzero(hi > lo)
            n = (hi - lo)[met]
            item = items[np.repeat(lo[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            hit = np.unique(item * wide + np.repeat(some[met // len(walks.seeds)], n))
            yield hit // wide, hit % wide

    def _everywhere(self, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places (item, begin, end, text), in order, around all windows of the texts whose walk agrees with one of an item's."""
        length, hits = np.diff(bounds), [np.zeros((0, 4), np.int64)]
        for walks, keys, items in self.walks:
            many = np.maximum(length - walks.size + 1, 0)
            starts = np.repeat(bounds[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            for item, at in self._met(value, walks, keys, items, starts):
                text = np.searchsorted(bounds, at, "right") - 1
                hits.append(np.stack([item, np.maximum(at - self.span[item], bounds[text]), np.minimum(at + self.span[item], bounds[text + 1]), text], axis=1))
        rows = np.concatenate(hits)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        # begins and ends of a text ascend together: places that touch are one
        apart = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 3]) != 0) | (rows[1:, 1] > rows[:-1, 2])
        first = np.flatnonzero(np.concatenate([[True], apart])[: len(rows)])
        last = np.append(first[1:], len(rows)) - 1 if len(rows) else first
        return np.stack([rows[first, 0], rows[first, 1], rows[last, 2], rows[first, 3]], axis=1)

    def _candidates(self, value: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each place (item, begin, end, text), in order, has a window whose walk agrees with one of its item's."""
        out = np.zeros(len(places), bool)
        wide = len(value) + 1
        for walks, keys, items in self.walks:
            own = np.flatnonzero(self.size[places[:, 0]] == walks.size)
            if not len(own):
                continue
            begin, many = places[own, 1], np.maximum(places[own, 2] - places[own, 1] - walks.size + 1, 0)
            starts = np.unique(np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum()))
            key = places[own, 0] * wide + begin
            for item, at in self._met(value, walks, keys, items, starts):
                # the places of an item may overlap: the last one that begins before a window, and the one before it
                last = np.searchsorted(key, item * wide + at, "right") - 1
                for which in (last, last - 1):
                    row = own[np.maximum(which, 0)]
                    inside = (which >= 0) & (places[row, 0] == item) & (at + walks.size <= places[row, 2]) & (at >= places[row, 1])
                    out[row[inside]] = True
        return out

    def _apart(self, item: int, text: np.ndarray) -> bool:
        """Whether a stretch lacks too many of an item's words: each of them costs an edit at least."""
        bag, have = self.bags[item], Counter(text.tolist())
        lacking = len(self.words[item]) - sum(min(n, have[w]) for w, n in bag.items() if w in have)
        return lacking > self.most[item]

    def _distance(self, item: int, text: np.ndarray) -> tuple[int, int, int]:
        """(edits, begin, end): the stretch of ``text`` with the fewest edits to an item; the first, shortest one of equals."""
        words = self.words[item].tolist()
        n, m = len(words), len(text)
        cost = np.zeros(m + 1, np.int64)
        began = np.arange(m + 1)
        ramp = np.arange(m + 1)
        for w in words:
            keep = cost[:-1] + (text != np.uint64(w))
            drop = cost[1:] + 1
            best = np.minimum(keep, drop)
            origin = np.where(keep <= drop, began[:-1], began[1:])
            new = np.concatenate([[cost[0] + 1], best])
            origin = np.concatenate([[began[0]], origin])
            # skipping words of the text costs one each: a running minimum along the row
            low = np.minimum.accumulate(new - ramp)
            source = np.maximum.accumulate(np.where(new - ramp == low, ramp, 0))
            cost, began = low + ramp, origin[source]
        end = int(cost.argmin())
        return int(cost[end]), int(began[end]), end

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, first word, behind the last word), the best of each text and item."""
        done = 0
        for part in pieces(texts):
            value, bounds = _words(texts[part])
            length, begin = np.diff(bounds), bounds[:-1]
            owner = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(value)) - begin[owner]
            if self.how.runs:
                rows = [(item, max(int(begin[text]), a), min(int(bounds[text + 1]), b), text) for text, item, a, b in self._places(value, place, length, owner)]
                places = np.array(sorted(rows), np.int64).reshape(-1, 4)
                places = places[self._candidates(value, places)]
            else:
                places = self._everywhere(value, bounds)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for item, a, b, text in places.tolist():
                if self._apart(item, value[a:b]):
                    continue
                cost, x, y = self._distance(item, value[a:b])
                if cost <= self.most[item]:
                    hit = (cost, a - int(begin[text]) + x, a - int(begin[text]) + y)
                    best[text, item] = min(best.get((text, item), hit), hit)
            for (text, item), hit in sorted(best.items()):
                yield done + text, item, *hit
            done += part.stop - part.start


def benchmark_blocks(benchmark: DataFrame, how: Decontamination, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[tuple[int, bytes], ...]]:
    """The items in blocks of about ``block_bytes`` of text; null ids and null texts are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = n_bytes // how.block_bytes + 1
    for b in range(blocks):
        own = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = tuple(sorted((r.id, r.text.encode()) for r in own.distinct().collect()))  # about block_bytes of text
        if got:
            yield got


@lru_cache(maxsize=2)
def _indexed(rows: tuple[tuple[int, bytes], ...], how: Decontamination) -> Items:
    """The index of a block, built once for each Python worker."""
    return Items(list(rows), how)


def _leaks(rows: tuple[tuple[int, bytes], ...], how: Decontamination):
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("edits", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = _indexed(rows, how)
            ids = batch.column("id").to_pylist()
            found = [(ids[t], items.ids[i], *rest) for t, i, *rest in items.find([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()])]
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], schema=schema)

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, item_col, edits, first_word, end_word): documents that hold an item with up to ``percent`` edited words.

    One row for each document and item found, at the place with the fewest edits, the first one of
    equals. Null and empty texts hold nothing, items without words are in nothing. Repeated rows and
    rows with a null id are each searched. Other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ddl = "id long, item long, edits long, first long, last long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for n, block in enumerate(benchmark_blocks(benchmark, how, item_col)):
        part = rows.mapInArrow(_leaks(block, how), ddl)
        out = part if n == 0 else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", F.col("first").alias("first_word"), F.col("last").alias("end_word"))


def _clean(rows: tuple[tuple[int, bytes], ...], how: Decontamination, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = _indexed(rows, how)
            texts = [x or b"" for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            keep = np.ones(len(texts), bool)
            keep[[x[0] for x in items.find(texts)]] = False
            yield batch.filter(pa.array(keep))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination(), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item (see benchmark_leaks)."""
    arrow_batches(docs.sparkSession)
    for block in benchmark_blocks(benchmark, how, item_col):
        docs = docs.mapInArrow(_clean(block, how, text_col), docs.schema)
    return docs
