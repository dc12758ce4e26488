"""Breaking cycles with few edges, and parts of bounded size: heuristics over components that may be large."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import graph

ORDERS = ("key_up", "key_down", "degree_up", "degree_down")


def cycle_edges(nodes: DataFrame, deps: DataFrame, rounds: int = 1, levels_of: Callable[[DataFrame, DataFrame], DataFrame] = graph.topological_levels) -> DataFrame:
    """(src, dst, component, gone): the dependencies inside strongly connected components; those that are gone leave no cycle, and are few, not the fewest.

    Inside a strongly connected component, an order of its nodes makes the dependencies that run
    against it a cut. Four orders are tried, by key and by the difference of dependencies and
    dependants, either way, and each component takes the one that cuts fewest. What is left has
    levels; cut dependencies that lead to a lower level come back, all of them at once, as they agree
    with one order. This is repeated ``rounds`` times. Dependencies on oneself always go.
    levels_of: takes a step a level; ``chains.deep_levels`` is for components with long chains.
    """
    held = cut(graph.strong_components(deps).join(nodes.select("key").distinct(), "key", "left_semi"))
    every = deps.filter("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    a, b = (held.select(F.col("key").alias(end), F.col("component").alias(f"{end}_of")) for end in ("src", "dst"))
    inside = cut(every.join(a, "src").join(b, "dst").filter("src_of = dst_of").select("src", "dst", F.col("src_of").alias("component")))
    loops, inside = inside.filter("src = dst"), inside.filter("src <> dst")
    ends = inside.select(F.explode(F.array(F.struct(F.col("src").alias("key"), F.lit(1).alias("d")), F.struct(F.col("dst").alias("key"), F.lit(-1).alias("d")))).alias("x")).select("x.*")
    degree = ends.groupBy("key").agg(F.sum("d").alias("d"))
    both = inside.join(degree.select(F.col("key").alias("src"), F.col("d").alias("sd")), "src").join(degree.select(F.col("key").alias("dst"), F.col("d").alias("dd")), "dst")
    first = {"key": F.col("src") > F.col("dst"), "degree": (F.col("sd") > F.col("dd")) | ((F.col("sd") == F.col("dd")) & (F.col("src") > F.col("dst")))}
    against = {f"{name}_{way}": (x if way == "up" else ~x) for name, x in first.items() for way in ("up", "down")}
    told = cut(both.select("src", "dst", "component", *[against[o].alias(o) for o in ORDERS]))
    counts = told.groupBy("component").agg(*[F.count_if(F.col(o)).alias(o) for o in ORDERS])
    best = counts.select("component", F.least(*[F.struct(F.col(o).alias("n"), F.lit(k).alias("k")) for k, o in enumerate(ORDERS)])["k"].alias("k"))
    which = F.element_at(F.array(*ORDERS), F.col("k") + 1)
    gone = cut(told.join(best, "component").select("src", "dst", "component", which.alias("gone")))
    for _ in range(rounds):
        if gone.filter("gone").isEmpty():
            break
        levels = cut(levels_of(held.select("key"), gone.filter("not gone").select("src", "dst")))
        at = lambda end: levels.select(F.col("key").alias(end), F.col("level").alias(f"{end}_level"))
        gone = cut(gone.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", "component", (F.col("gone") & (F.col("src_level") <= F.col("dst_level"))).alias("gone")))
    return gone.union(loops.select("src", "dst", "component", F.lit(True).alias("gone")))


def cycle_cut(nodes: DataFrame, deps: DataFrame, rounds: int = 1) -> DataFrame:
    """(src, dst, component): the dependencies to take out of ``deps`` so that no cycle is left, see cycle_edges."""
    return cycle_edges(nodes, deps, rounds).filter("gone").select("src", "dst", "component")


def bounded_parts(edges: DataFrame, nodes: DataFrame, most: int, rounds: int = 8) -> DataFrame:
    """(key, part, size): parts of ``nodes`` (key) of at most ``most`` nodes that few of ``edges`` (src, dst) run between.

    Size-bounded label propagation over parts: all nodes begin alone. In every round a hash makes each
    part one that asks or one that takes; one that asks turns to the taking part that it has most
    edges with among those with room for it, and a taking part admits askers by their number of
    edges until it is full. Rounds end after ``rounds``, or when several in a row admit none. Edges count both ways, those
    with an end outside ``nodes`` not. A part's name is that of one of its nodes.

    A part that very many ask is asked by salts first: more than ``most`` askers cannot be admitted,
    so each salt passes on that many at most.
    """
    keys = cut(nodes.filter("key is not null").select(F.col("key").cast("long").alias("key")).distinct())
    own = graph._inside(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), keys).filter("src <> dst")
    links = cut(own.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")))
    part = cut(keys.withColumn("part", F.col("key")))
    size = cut(keys.select(F.col("key").alias("part"), F.lit(1).cast("long").alias("size")))
    idle = 0
    for k in range(rounds):
        takes = lambda c, k=k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
        both = links.select(F.col("a").alias("asker"), F.col("b").alias("taker"), "n").union(links.select("b", "a", "n")).filter(~takes("asker") & takes("taker"))
        fits = both.join(size.select(F.col("part").alias("asker"), F.col("size").alias("own")), "asker").join(size.select(F.col("part").alias("taker"), F.col("size").alias("there")), "taker").filter(F.col("own") + F.col("there") <= most)
        asks = fits.groupBy("asker").agg(F.max(F.struct("n", (-F.col("taker")).alias("t"), "own", "there")).alias("x")).select("asker", (-F.col("x.t")).alias("taker"), "x.n", "x.own", "x.there")
        order = [F.col("n").desc(), F.col("asker")]
        salted = asks.withColumn("salt", F.pmod(F.xxhash64("asker"), F.lit(64)))
        few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("taker", "salt").orderBy(*order))).filter(F.col("rank") <= most)
        upto = F.sum("own").over(Window.partitionBy("taker").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        moves = cut(few.withColumn("upto", upto).filter(F.col("upto") + F.col("there") <= most).select(F.col("asker").alias("part"), "taker"))
        if moves.isEmpty():
            idle += 1
            if idle == 4:
                break
            continue
        idle = 0
        renamed = lambda df, c: df.join(moves.select(F.col("part").alias(c), F.col("taker").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        part = cut(renamed(part, "part"))
        size = cut(renamed(size, "part").groupBy("part").agg(F.sum("size").alias("size")))
        links = renamed(renamed(links, "a"), "b").filter("a <> b")
        links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n")))
    return part.join(size, "part").select("key", "part", "size")


def edges_between(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst): the distinct edges whose ends lie in two parts (key, part)."""
    at = lambda end: parts.select(F.col("key").alias(end), F.col("part").alias(f"{end}_part"))
    return edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").filter("src_part <> dst_part").select("src", "dst")
