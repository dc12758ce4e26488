"""Graphs contracted inside blocks of keys, each by a task of its own, before cycles between blocks are looked for.

A block is a run of 2**BITS keys, so it has a bounded number of nodes however large the graph is; a
block with more than EDGES edges inside is not contracted, and its edges count as edges between blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored

BITS = 17  # a block has 131,072 keys
EDGES = 1_000_000  # inside a block that a task contracts (some ten MB)
_EDGE, _ENTRY, _EXIT = 0, 1, 2
_MEMBER, _LEFT, _OUT, _IN = 0, 1, 2, 3


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The strong component of each of ``n`` nodes (Tarjan); an edge between two leads to the smaller number."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, of, count, met = [0] * n, [0] * n, [-1] * n, 0, 0
    at, open_ = first[:n], []
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            v = path[-1]
            if not seen[v]:
                met += 1
                seen[v] = low[v] = met
                open_.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif of[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while of[v] < 0:
                    of[open_.pop()] = count
                count += 1
    return np.array(of, dtype=np.int64)


def _block(table: pa.Table) -> pa.Table:
    """Of a block's edges and ends of edges to and from others (kind, a, b): members of components, edges on a way through, and ends of such ways."""
    kind, a, b = (table.column(c).to_numpy() for c in ("kind", "a", "b"))
    keys, place = np.unique(np.concatenate([a, b[kind == _EDGE]]), return_inverse=True)
    src, dst = place[: len(a)][kind == _EDGE], place[len(a) :]
    entry, exit_ = place[: len(a)][kind == _ENTRY], place[: len(a)][kind == _EXIT]
    of = _components(len(keys), src, dst)
    name = np.zeros(of.max() + 1, dtype=np.int64)
    name[of] = keys  # keys ascend, so the largest stays
    here, there = of[src], of[dst]
    between = np.unique(np.stack([here, there], axis=1)[here != there], axis=0)
    begun, ends = np.zeros(len(name), dtype=bool), np.zeros(len(name), dtype=bool)
    begun[of[entry]], ends[of[exit_]] = True, True
    for x, y in between[np.argsort(-between[:, 0], kind="stable")].tolist():
        begun[y] |= begun[x]
    for x, y in between[np.argsort(between[:, 1], kind="stable")].tolist():
        ends[x] |= ends[y]
    through = begun & ends
    way = between[through[between[:, 0]] & through[between[:, 1]]]
    many = np.flatnonzero(np.bincount(of)[of] > 1)
    out, into = exit_[begun[of[exit_]]], entry[ends[of[entry]]]
    parts = [(_MEMBER, keys[many], name[of[many]]), (_LEFT, name[way[:, 0]], name[way[:, 1]]), (_OUT, keys[out], name[of[out]]), (_IN, keys[into], name[of[into]])]
    return pa.table({"kind": pa.array(np.repeat([k for k, *_ in parts], [len(x) for _, x, _ in parts]).astype(np.int32)), "a": np.concatenate([x for _, x, _ in parts]), "b": np.concatenate([y for *_, y in parts])})


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, component) of the nodes on cycles inside a block, component being the largest key; and the edges (src, dst) on which cycles between blocks can lie.

    edges: distinct pairs (src, dst) without loops, stored. A contracted component goes by its
    largest key in the second table. Inside a block only what lies on a way from an edge that enters
    it to one that leaves it is left.
    """
    block = lambda c: F.shiftright(c, BITS)
    same = edges.filter(block("src") == block("dst")).select(block("src").alias("block"), "src", "dst")
    full = stored(same.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > EDGES).select("block"))
    across = edges.filter(block("src") != block("dst"))
    if not full.isEmpty():
        across = across.union(same.join(full, "block", "left_semi").select("src", "dst"))
        same = same.join(full, "block", "left_anti")
    ends = lambda c, kind: across.select(block(c).alias("block"), F.lit(kind).alias("kind"), F.col(c).alias("a"), F.col(c).alias("b")).distinct()
    rows = same.select("block", F.lit(_EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).union(ends("dst", _ENTRY)).union(ends("src", _EXIT))
    found = stored(rows.groupBy("block").applyInArrow(_block, "kind int, a long, b long"))
    of = lambda kind, a, b: found.filter(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b))
    kept = across.join(of(_OUT, "src", "from"), "src").join(of(_IN, "dst", "into"), "dst").select(F.col("from").alias("src"), F.col("into").alias("dst"))
    return of(_MEMBER, "key", "component"), stored(of(_LEFT, "src", "dst").union(kept.filter("src <> dst")).distinct())
