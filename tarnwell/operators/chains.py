"""Deep graphs: chains are contracted by pointer doubling, so steps grow with the logarithm of a chain's length.

A node with exactly one edge onwards is a link. Links point at what their edge leads to; in every
round a link takes over the pointer of the link it points at, so pointers double their reach until
all of them end at a node that is no link, the head. What is left are heads and the edges between
them, and a walk over these has no chains to follow.

Keys often follow the chains, so links are dealt by ranges of keys first and each range is contracted
by a task of its own, by the same doubling. What points into another range goes on in joins, over
the links that are pointed at so, the portals; where keys don't follow the chains, these are most.

Pointers of a round are joined by their target; a target that many links point at is dealt to several
tasks, where targets are too many to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import graph
from .graph import SALTS, _parts, reachable

RANGE = 200_000  # links in a range that a task contracts (some ten MB)
LEAST_SHARE = 0.1  # share of links among nodes from which it pays to contract once more


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src is not null and dst is not null").distinct()


def _lookup(rows: DataFrame, column: str, table: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``column`` with ``table`` (key, ...), of ``n`` counted rows and one row a key; many rows may have one key."""
    if n <= graph.SMALL:
        return rows.join(F.broadcast(table), F.col(column) == F.col("key"), how).drop("key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    every = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, (F.col(column) == F.col("key")) & (F.col("_salt") == F.col("_s")), how).drop("key", "_salt", "_s")


def _local(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a range of links (at, to, sum): what each points at behind the last link of the range, the sum on the way and how many nulls it
    has, whether it never leaves the range, and the place it points at in the range (-1: none) in every round of doubling."""
    at, to = (table.column(c).to_numpy() for c in ("at", "to"))
    to, total, nulls = to.copy(), table.column("sum").fill_null(0.0).to_numpy().copy(), table.column("sum").is_null().to_numpy().astype(float)
    order = np.argsort(at)
    found = np.minimum(np.searchsorted(at, to, sorter=order), len(at) - 1)
    following = np.where(at[order[found]] == to, order[found], -1)
    rounds = []
    for _ in range(len(at).bit_length()):
        inner = np.flatnonzero(following >= 0)
        if not len(inner):
            break
        rounds.append(following)
        ahead = following[inner]
        following = following.copy()
        to[inner], following[inner] = to[ahead], rounds[-1][ahead]
        total[inner], nulls[inner] = total[inner] + total[ahead], nulls[inner] + nulls[ahead]
    return to, total, nulls, following >= 0, rounds


_MET = "at long, to long, sum double, open boolean"


def _contracted(table: pa.Table) -> pa.Table:
    to, total, nulls, ring, _ = _local(table)
    at = table.column("at").to_numpy()
    return pa.table({"at": at, "to": np.where(ring, at, to), "sum": pa.array(np.where(ring, 0.0, total), mask=(nulls > 0) & ~ring), "open": ring})


def _marked(table: pa.Table) -> pa.Table:
    """(key): the links of a range behind marked ones, these included."""
    mark = table.column("mark").to_numpy(zero_copy_only=False).copy()
    for following in _local(table)[4]:
        ahead = following[mark]
        mark[ahead[ahead >= 0]] = True
    return pa.table({"key": table.column("at").to_numpy()[mark]})


@dataclass(frozen=True)
class _Chains:
    """links (at, to, sum, part), dealt by ranges; exits (at, to, sum, open): where each leaves its range; portals (at, to, sum, open):
    heads of the links that are pointed at from another range, and the pointers of every round for them."""

    links: DataFrame
    exits: DataFrame
    portals: DataFrame
    n_portals: int
    rounds: list[DataFrame]

    def heads(self) -> DataFrame:
        """(at, to, sum, open) of all links: where their chain ends; open: in a circle of links."""
        ends = self.portals.select(F.col("at").alias("key"), F.col("to").alias("_to"), F.col("sum").alias("_sum"), F.col("open").alias("_open"))
        out = _lookup(self.exits, "to", ends, self.n_portals, "left")
        return out.select("at", F.coalesce("_to", "to").alias("to"), (F.col("sum") + F.when(F.col("_to").isNull(), 0.0).otherwise(F.col("_sum"))).alias("sum"), (F.col("open") | F.coalesce("_open", F.lit(False))).alias("open"))

    def behind(self, entered: DataFrame) -> DataFrame:
        """(key): the links behind those of ``entered`` (key), these included."""
        met = cut(self.exits.join(entered.select(F.col("key").alias("at")), "at", "left_semi").select(F.col("to").alias("key")).distinct())
        marked = cut(met.join(self.portals.select(F.col("at").alias("key")), "key", "left_semi"))
        for pointers in self.rounds:  # a round reaches twice as far as all before it
            more = marked.join(pointers.select(F.col("at").alias("key"), "to"), "key").select(F.col("to").alias("key"))
            marked = cut(marked.union(more).distinct())
        begun = entered.select("key").union(marked).distinct().select(F.col("key").alias("at"), F.lit(True).alias("mark"))
        return self.links.join(begun, "at", "left").withColumn("mark", F.coalesce("mark", F.lit(False))).groupBy("part").applyInArrow(_marked, "key long")


def _chains(links: DataFrame, n: int, keep: bool = False) -> _Chains:
    """The chains of ``n`` links (at, to, sum). Ranges of RANGE links are contracted in tasks; pointers between ranges are doubled in joins.

    Where keys follow the chains, few pointers leave a range; where they don't, nearly all do, and doubling has the work.
    """
    spread = max(1, -(-n // RANGE))
    dealt = cut(links.select("at", "to", "sum").repartitionByRange(spread, "at").withColumn("part", F.spark_partition_id()))
    exits = cut(dealt.groupBy("part").applyInArrow(_contracted, _MET))
    targets = exits.filter("not open").select(F.col("to").alias("at")).distinct()
    portals = cut(exits.join(targets, "at", "left_semi").select("at", "to", "sum"))
    n_portals = portals.count()
    ends, rounds = _doubled(portals, n_portals, keep) if n_portals else (portals.withColumn("open", F.lit(False)), [])
    return _Chains(dealt, exits, ends, n_portals, rounds)


def _doubled(links: DataFrame, n: int, keep: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Heads (at, to, sum, open) of ``n`` links (at, to, sum); open: the pointer ends in a cycle of links. keep: also the pointers of every round.

    sum: of what lies on the way. n.bit_length() rounds are enough for the longest chain.
    """
    spread = _spread(links, n)
    now = cut(links.select("at", "to", "sum").repartition(spread, "at").sortWithinPartitions("at"))
    names = now.select(F.col("at").alias("key"), F.lit(True).alias("link"))
    now = cut(_lookup(now, "to", names, n, "left").select("at", "to", "sum", F.coalesce("link", F.lit(False)).alias("open")))
    rounds = [now]
    for _ in range(n.bit_length()):
        if now.filter("open").isEmpty():
            break
        further = now.select(F.col("at").alias("key"), F.col("to").alias("_to"), F.col("sum").alias("_sum"), F.col("open").alias("_open"))
        moved = _lookup(now.filter("open"), "to", further, n).select("at", F.col("_to").alias("to"), (F.col("sum") + F.col("_sum")).alias("sum"), F.col("_open").alias("open"))
        now = cut(now.filter("not open").union(moved).repartition(spread, "at"))
        rounds.append(now)
    return now, rounds if keep else []


def _spread(df: DataFrame, n: int) -> int:
    """Tasks for ``n`` rows: few rows don't need all of them."""
    return min(_parts(df), max(1, -(-n // 50_000)))


def _links(edges: DataFrame) -> DataFrame:
    """(key): nodes with exactly one edge onwards."""
    return edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n")).filter("n = 1").select("key")


def deep_reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key): as ``graph.reachable``; a chain of n nodes takes a number of jobs that grows with log n.

    The walk runs over heads; then the links behind those that it entered are marked: first portals,
    with the pointers of every round, each of which doubles how far a mark comes, then inside ranges.
    """
    edges = cut(_plain(edges))
    links = cut(_links(edges))
    n = links.count()
    if not n:
        return reachable(edges, seeds)
    own = edges.join(links.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0.0).alias("sum"))
    chains = _chains(own, n, keep=True)
    ahead = chains.heads().filter("not open").select(F.col("at").alias("src"), F.col("to").alias("dst"))
    entered = cut(reachable(ahead.union(edges.join(links.select(F.col("key").alias("src")), "src", "left_anti").select("src", "dst")), seeds))
    return entered.union(chains.behind(entered.join(links, "key", "left_semi"))).distinct()


def _contract(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Nodes and edges without links, and the links' (key, to, sum); edges: (src, dst, len), the longest of each pair."""
    links = cut(nodes.join(_links(edges), "key", "left_semi"))
    n = links.count()
    if not n:
        return nodes, edges, None, 0
    own = edges.join(links.withColumnRenamed("key", "src"), "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("len") + F.col("weight")).alias("sum"))
    heads = cut(_chains(own, n).heads().filter("not open").select(F.col("at").alias("key"), "to", "sum"))
    rest = edges.join(links.select(F.col("key").alias("src")), "src", "left_anti")
    ahead = _lookup(rest, "dst", heads.select("key", "to", F.col("sum").alias("more")), n, "left")
    merged = ahead.select("src", F.coalesce("to", "dst").alias("dst"), (F.col("len") + F.coalesce("more", F.lit(0.0))).alias("len")).groupBy("src", "dst").agg(F.max("len").alias("len"))
    return cut(nodes.join(links, "key", "left_anti")), cut(merged), heads, n


def _peel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cp) of the nodes not on or behind a cycle: weight plus the largest len + cp over their edges; a step a level."""
    dealt = cut(edges.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int")).repartition(_parts(edges), "dst", "salt").sortWithinPartitions("dst", "salt"))
    need = cut(nodes.join(edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("need")), "key", "left"))
    ready = cut(need.filter("need is null").select("key", F.col("weight").alias("cp")))
    need = need.filter("need is not null")
    out, partly, step = ready, need.select("key", "weight", "need", F.lit(None).cast("double").alias("best")).limit(0), 0
    while n := ready.count():
        told = graph._step(dealt, "dst", ready, n).groupBy(F.col("src").alias("key")).agg(F.count("*").alias("met"), F.max(F.col("len") + F.col("cp")).alias("more"))
        begun = told.join(partly.select("key"), "key", "left_anti").join(need, "key").select("key", "weight", (F.col("need") - F.col("met")).alias("need"), F.col("more").alias("best"))
        known = partly.join(told, "key", "left").select("key", "weight", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), F.greatest("best", "more").alias("best"))
        moved = cut(known.union(begun).repartition(_parts(edges), "key"))
        ready, partly = moved.filter("need = 0").select("key", (F.col("weight") + F.col("best")).alias("cp")), moved.filter("need > 0")
        out, step = out.union(ready), step + 1
        if step % graph.COMPACT == 0:
            out = cut(out)
    return out


def deep_critical_path(weights: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, cp): as ``graph.critical_path``; a chain of n nodes takes a number of jobs that grows with log n.

    Links are taken out with the weights on their way summed up, until few are left; heads are peeled
    level by level, and links get their sum and what their head has, the last ones taken out first.
    """
    nodes = cut(weights.filter("key is not null").select(F.col("key").cast("long").alias("key"), F.col("weight").cast("double").alias("weight")).dropDuplicates(["key"]))
    edges = cut(_plain(deps).withColumn("len", F.lit(0.0)).join(nodes.select(F.col("key").alias("src")), "src", "left_semi").select("src", "dst", "len"))
    left, taken = nodes.count(), []
    while left:
        nodes, edges, heads, n = _contract(nodes, edges)
        if heads is None:
            break
        taken.append((heads, n))
        left -= n
        if n < LEAST_SHARE * left:
            break
    paths = _peel(nodes, edges)
    for heads, _ in reversed(taken):
        paths = cut(paths)
        paths = paths.union(_lookup(heads.withColumnRenamed("key", "at"), "to", paths, paths.count()).select(F.col("at").alias("key"), (F.col("sum") + F.col("cp")).alias("cp")))
    return paths


def deep_levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, level): as ``graph.topological_levels``, on deep graphs."""
    keys = nodes.select(F.col("key").cast("long").alias("key")).filter("key is not null").distinct()
    paths = deep_critical_path(keys.withColumn("weight", F.lit(1.0)), deps)
    return keys.join(paths.select("key", (F.col("cp") - 1).cast("int").alias("level")), "key", "left")
