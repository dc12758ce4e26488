"""Product-quantised vector codes; nearest codebook entries are found in a geometric near-neighbour tree.

A vector's components become integers floor(scale * x) and the vector is cut into equal consecutive
parts. Each part position has a codebook, at first that part of the vectors with the smallest ids;
every round assigns each part to its nearest entry and replaces an entry by the componentwise floor
of its parts' mean. Codebooks are at most ``entries`` rows a position, so they go to the driver and to
every task; vectors are read where they lie and only sums by entry are shuffled.

The tree (GNAT) is built over the entries of one codebook. A node has up to ``fan`` split points; the
other entries go to their nearest split point's child, and the node keeps, for every split point and
every child, the least and the largest distance from that point to the child's entries. A query's
distance to a split point, with the distance of the best entry so far, rules out a whole child by
the triangle inequality. Only children that are farther than the best entry go (an equally far entry
with a lower index must be seen); bounds are widened by more than the error of square roots, and
distances are compared as integers, ties to the lower index.

Rows with a null vector, null or non-finite components, components of 2**15 or more (whose errors
leave 64 bits), or another length than the vector of the smallest id among lengths that can be cut
into the parts, are dropped. Rows with a null id are encoded, but give no first entry before others
do; repeated ids are each encoded, ordered by their vectors. An empty table gives no rows and empty
codebooks; with fewer vectors than entries the codebooks are shorter. Other columns of the table are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LARGEST = 1 << 15
SMALL = 100_000  # counted labels up to which their totals are handed to every task
QUERIES = 4096  # vectors that go through a tree at once
SALTS = 16


@dataclass(frozen=True)
class Coding:
    """parts: pieces of a vector; entries: rows of a codebook, at most 256; rounds: of reassignment; scale: of the integers; fan: split points of a tree's node."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    fan: int = 16


@dataclass(frozen=True)
class Codes:
    """rows: (id, label, code binary, error); codebooks: int64 (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """sha256 of all components as decimal numbers by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


class Node:
    """split: entries that are split points; children: nodes or None; low, high: (split point, child) ranges of distances; leaf: entries without further split."""

    __slots__ = ("split", "children", "low", "high", "leaf")

    def __init__(self, split, children, low, high, leaf):
        self.split, self.children, self.low, self.high, self.leaf = split, children, low, high, leaf


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``b``, exact; by a product of matrices where all its sums stay below 2**53."""
    if a.size and b.size and a.shape[1] * (int(max(np.abs(a).max(), np.abs(b).max())) << 1) ** 2 < 1 << 53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        out += gap * gap
    return out


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Places of ``n`` points far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    least = squares(points, points[:1])[:, 0]
    while len(chosen) < n:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, squares(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def build(book: np.ndarray, fan: int, which: np.ndarray | None = None) -> Node:
    """The tree over the entries ``which`` of a codebook; equal entries stay together in a leaf."""
    which = np.arange(len(book)) if which is None else which
    if len(which) <= fan or (book[which] == book[which[0]]).all():
        return Node(None, (), None, None, which)
    at = _spread(book[which], fan)
    at = at[np.unique(book[which[at]], axis=0, return_index=True)[1]]  # equal entries are one split point, the others go below it
    split = which[at]
    rest = np.setdiff1d(which, split, assume_unique=True)
    far = squares(book[split], book[rest])
    owner = far.argmin(0)
    root = np.sqrt(far.astype(np.float64))
    held = [np.flatnonzero(owner == j) for j in range(len(split))]
    low = np.array([[root[i, x].min() if len(x) else np.inf for x in held] for i in range(len(split))])
    high = np.array([[root[i, x].max() if len(x) else -np.inf for x in held] for i in range(len(split))])
    return Node(split, tuple(build(book, fan, rest[x]) if len(x) else None for x in held), low, high, None)


def _slack(x: np.ndarray) -> np.ndarray:
    """More than the rounding of a square root and of a sum of two."""
    return x * 1e-12 + 1e-9


class _Search:
    """The nearest entries of a block of queries; counts what was compared."""

    def __init__(self, book: np.ndarray, queries: np.ndarray):
        self.book, self.q = book, queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.zeros(len(queries), np.int64)
        self.compared = 0

    def _see(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        far = squares(self.q[rows], self.book[which])
        self.compared += far.size
        least = far.min(1)
        lowest = np.where(far == least[:, None], which[None, :], np.iinfo(np.int64).max).min(1)
        better = (least < self.best[rows]) | ((least == self.best[rows]) & (lowest < self.entry[rows]))
        self.best[rows[better]], self.entry[rows[better]] = least[better], lowest[better]
        return far

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if node.leaf is not None:
            self._see(rows, node.leaf)
            return
        root = np.sqrt(self._see(rows, node.split).astype(np.float64))
        nearest = root.argmin(1)
        for turn in (True, False):  # the nearest split point's child first: it gives the radius for the others
            for j, child in enumerate(node.children):
                mine = np.flatnonzero((nearest == j) == turn)
                if child is None or not len(mine):
                    continue
                radius = np.sqrt(self.best[rows[mine]].astype(np.float64))
                wide = radius[:, None] + _slack(radius[:, None] + root[mine] + np.where(np.isfinite(node.high[:, j]), node.high[:, j], 0.0))
                stays = ((root[mine] - wide <= node.high[:, j]) & (root[mine] + wide >= node.low[:, j])).all(1)
                if stays.any():
                    self.visit(child, rows[mine[stays]])


def nearest(book: np.ndarray, tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, distances computed) of each query; ties to the lower index."""
    entry, best, compared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(queries), QUERIES):
        search = _Search(book, queries[at : at + QUERIES])
        search.visit(tree, np.arange(len(search.q)))
        entry.append(search.entry)
        best.append(search.best)
        compared += search.compared
    return np.concatenate(entry), np.concatenate(best), compared


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, width)


def _assign(books: np.ndarray, trees: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of each vector, a column a part."""
    size = books.shape[2]
    found = [nearest(book, tree, x[:, p * size : (p + 1) * size])[:2] for p, (book, tree) in enumerate(zip(books, trees, strict=True))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray, trees: list[Node]):
    """Of each part and entry the number and the sum of its parts, one row for each that a task met."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            x = _vectors(batch, parts * size)
            entry, _ = _assign(books, trees, x)
            for p in range(parts):
                n[p] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(total[p], entry[:, p], x[:, p * size : (p + 1) * size])
        part, met = np.nonzero(n)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(met, pa.int32()), pa.array(n[part, met]), pa.array(total[part, met].tolist(), pa.list_(pa.int64()))], schema=schema)

    return run


def _codes(books: np.ndarray, trees: list[Node]):
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("code", pa.binary()), ("error", pa.int64())])
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = _assign(books, trees, _vectors(batch, parts * size))
            code = [row.tobytes() for row in entry.astype(np.uint8)]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(code, pa.binary()), pa.array(far.sum(1))], schema=schema)

    return run


def _integers(df: DataFrame, how: Coding, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label as text, x): the rows that can be encoded but for their length."""
    known = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter(F.forall("x", known) & (F.size("x") > 0) & (F.size("x") % how.parts == 0))
    return rows.select("id", "label", F.transform("x", lambda x: F.floor(x * how.scale).cast("int")).alias("x"))


def vector_codes(df: DataFrame, how: Coding = Coding(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of all vectors and the codebooks; labels come as text."""
    if not 1 <= how.entries <= 256:
        raise ValueError("a code's byte names at most 256 entries")
    scratch = Scratch(df.sparkSession, "vector_codes")
    rows = scratch.save(_integers(df, how, id_col, vector_col, label_col), "integers")
    in_order = [F.col("id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*in_order).select(F.size("x").alias("n")).first()
    if first is None:
        return Codes(rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((how.parts, 0, 0), np.int64))
    rows = rows.filter(F.size("x") == first.n)
    size = first.n // how.parts
    start = np.array([r.x for r in rows.orderBy(*in_order).select("x").limit(how.entries).collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), how.parts, size).transpose(1, 0, 2))
    kind = "part int, entry int, n long, total array<long>"
    for _ in range(how.rounds):
        sums = rows.select("x").mapInArrow(_sums(books, [build(book, how.fan) for book in books]), kind).groupBy("part", "entry")
        books = books.copy()
        for r in sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(size)]).alias("total")).collect():
            books[r.part, r.entry] = [t // r.n for t in r.total]
    coded = rows.mapInArrow(_codes(books, [build(book, how.fan) for book in books]), "id long, label string, code binary, error long")
    return Codes(scratch.save(coded, "codes"), books)


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: errors added up over equal labels, nulls together.

    Totals go to every task up to 100,000 counted labels; beyond, both sides are dealt by label and salt.
    """
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    n = totals.count()
    same = codes["label"].eqNullSafe(totals["label"])
    if n <= SMALL:
        return codes.join(F.broadcast(totals), same).drop(totals["label"])
    dealt = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    every = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return dealt.join(every, dealt["label"].eqNullSafe(every["of"]) & (F.col("salt") == F.col("s"))).drop("of", "s", "salt")
