"""Walks that carry more than a mark: tables of dispatch found on the way, sets of labels, changes of a graph.

Like ``graph.reachable`` these take a small distributed plan a step. Edges are dealt once by the end
at which steps enter them and stay there, as columns on the executors' disks; what moves is a step's
frontier and what it finds. Frontiers and visited sets are broadcast up to ``graph.SMALL`` counted rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard, stored, tidy_shuffles
from . import graph
from .graph import SALTS, _parts, _union

FUNCTION, TABLE, SLOT = 0, 1, 2  # kinds of what a dispatch walk meets
WORD = 64  # labels in a word of a label set
BUCKETS = 65_536  # of a hash, by which rows are counted before those of single nodes are
SPREAD = 16  # pairs of nodes for each seed up to which labels are looked up by pairs and not walked


def _long(df: DataFrame, **columns: str) -> DataFrame:
    """The columns ``columns`` (new name = old one) as numbers, distinct, without rows that have a null."""
    out = df.select(*[F.col(old).cast("long").alias(new) for new, old in columns.items()])
    for name in columns:
        out = out.filter(F.col(name).isNotNull())
    return out.distinct()


def _hubs(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """The values of ``by`` that more than graph.HUB of ``rows`` have, if any. Rows are counted by buckets of a hash first: only buckets with as many can hold one."""
    hashed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
    full = cut(hashed.groupBy("_bucket").agg(F.count("*").alias("n")).filter(F.col("n") > graph.HUB).select("_bucket"))
    if full.isEmpty():
        return None
    hubs = cut(hashed.join(F.broadcast(full), "_bucket", "left_semi").groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > graph.HUB).select(*by))
    return None if hubs.isEmpty() else hubs


class _Dealt:
    """``rows`` dealt and sorted by ``by``; those of hubs lie apart, in several partitions each, told by a salt of ``other``.

    So only nodes that are hubs are copied to reach all of their rows. The rows are kept as columns on
    the executors' disks until ``release``; where an executor is lost, its share is made again from ``rows``.
    """

    def __init__(self, rows: DataFrame, by: list[str], other: str):
        self.by, self.hubs = by, _hubs(rows, by)
        plain = rows if self.hubs is None else rows.join(F.broadcast(self.hubs), by, "left_anti")
        self.plain = self.heavy = _kept(plain, by)
        if self.hubs is not None:
            self.heavy = _kept(rows.join(F.broadcast(self.hubs), by, "left_semi").withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")), [*by, "salt"])

    def entered(self, nodes: DataFrame, n: int, ends: tuple[int, int] | None = None) -> DataFrame:
        """The rows that ``nodes``, of counted size ``n``, enter, with the columns of both; ends: their least and greatest key, beyond which no row is read."""
        few = n <= graph.SMALL
        plain = self.plain if ends is None else self.plain.filter(F.col(self.by[0]).between(*ends))  # sorted, so whole batches are passed over
        out = plain.join(F.broadcast(nodes) if few else nodes.hint("merge"), self.by)
        if self.hubs is None:
            return out
        if few:
            return out.unionByName(self.heavy.drop("salt").join(F.broadcast(nodes), self.by))
        spread = nodes.join(F.broadcast(self.hubs), self.by, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return out.unionByName(self.heavy.join(spread.hint("merge"), [*self.by, "salt"]).drop("salt"))

    def release(self) -> None:
        self.plain.unpersist()
        self.heavy.unpersist()


def _kept(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` dealt and sorted by ``by``, on the executors' disks; counted, so that it is known how they lie when joins are planned."""
    kept = rows.repartition(_parts(rows), *by).sortWithinPartitions(*by).persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


class _Met:
    """What a walk has met, in tables that do not overlap; keys name its columns."""

    def __init__(self, keys: list[str]):
        self.keys, self.parts, self.n = keys, [], 0

    def new(self, found: DataFrame) -> tuple[DataFrame, int]:
        """The rows of ``found`` that were not met before, and their number; they count as met from now on."""
        found = found.select(*self.keys).distinct()
        if self.parts:
            found = found.join(F.broadcast(self.all()) if self.n <= graph.SMALL else self.all(), self.keys, "left_anti")
        found = stored(found)
        n = found.count()
        self.n += n
        self.parts.append((found, n))
        if len(self.parts) > graph.COMPACT:  # tables with a good share of all rows stay, so that they are not written time and again
            few = [part for part in self.parts if part[1] * graph.COMPACT <= self.n]
            self.parts = [part for part in self.parts if part[1] * graph.COMPACT > self.n]
            if few:
                self.parts.append((stored(_union([df for df, _ in few]).coalesce(_parts(found))), sum(m for _, m in few)))
        return found, n

    def all(self) -> DataFrame:
        return _union([df for df, _ in self.parts])


@dataclass(frozen=True)
class Live:
    """reached (key): functions; tables (vtable): dispatch tables that a reached function builds; slots (slot): methods called through a table."""

    reached: DataFrame
    tables: DataFrame
    slots: DataFrame


def live_dispatch(edges: DataFrame, seeds: DataFrame, builds: DataFrame, methods: DataFrame, calls: DataFrame | None = None) -> Live:
    """Reachability with dispatch tables that count only where a reached function builds them.

    edges (src, dst): direct calls. builds (src, vtable): function src turns a value into a dynamic
    one with this table. methods (vtable, slot, dst): what a table holds. calls (src, slot): dynamic
    calls of a method; a method dst is reached once its table is built by a reached function and its
    slot is called by one. Without ``calls`` every method of a live table is reached, and a slot is
    not looked at (it may be missing or null).

    Both sets grow together: functions that are reached build tables and call slots, and each new
    table and each new slot brings the methods whose other half is known already. Every step joins
    what is new with the rest, so no pair is looked at twice; steps end when nothing is new. Null
    keys are ignored.
    """
    walk = _Dispatch(edges, builds, methods, calls)
    walk.follow(_long(seeds, key="key").select(F.lit(FUNCTION).alias("kind"), "key"), calls is not None)
    walk.release()
    of = lambda k, name: walk.met.all().filter(F.col("kind") == k).select(F.col("key").alias(name))
    return Live(of(FUNCTION, "key"), of(TABLE, "vtable"), of(SLOT, "slot"))


def dispatch_ways(edges: DataFrame, seeds: DataFrame, builds: DataFrame, methods: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key) three times: what ``live_dispatch`` reaches with ``calls``, what it reaches without, and what seeds and the methods of all tables reach.

    Each holds the one before. So a walk goes on from where the one before ended, by the methods that
    it has in addition, and no edge is entered twice.
    """
    walk = _Dispatch(edges, builds, methods, calls)
    reached = lambda: walk.met.all().filter(F.col("kind") == FUNCTION).select("key")
    walk.follow(_long(seeds, key="key").select(F.lit(FUNCTION).alias("kind"), "key"), True)
    called = reached()
    walk.follow(walk.held_by_met(), False)
    live = reached()
    walk.follow(_long(methods, key="dst").select(F.lit(FUNCTION).alias("kind"), "key"), False)
    walk.release()
    return called, live, reached()


class _Dispatch:
    """A walk over functions, tables and slots; see live_dispatch. Function rows are dealt once and serve every ``follow``."""

    def __init__(self, edges: DataFrame, builds: DataFrame, methods: DataFrame, calls: DataFrame | None):
        def rows(df: DataFrame, to: str, kind: int) -> DataFrame:
            return df.select(F.col("src").cast("long").alias("key"), F.col(to).cast("long").alias("to"), F.lit(kind).alias("to_kind")).filter("key is not null and to is not null")

        given = rows(edges, "dst", FUNCTION).union(rows(builds, "vtable", TABLE))
        self.out = _Dealt(given if calls is None else given.union(rows(calls, "slot", SLOT)), ["key"], "to")
        slot = F.lit(None).cast("long") if calls is None else F.col("slot").cast("long")
        both = methods.select(F.col("vtable").cast("long").alias("vtable"), slot.alias("slot"), F.col("dst").cast("long").alias("dst")).filter("vtable is not null and dst is not null").distinct()
        self.by_table = _Dealt(both.select(F.col("vtable").alias("key"), F.col("slot").alias("other"), "dst"), ["key"], "dst")
        self.by_slot = None if calls is None else _Dealt(both.filter("slot is not null").select(F.col("slot").alias("key"), F.col("vtable").alias("other"), "dst"), ["key"], "dst")
        self.met = _Met(["kind", "key"])
        self.known: dict[int, list[DataFrame]] = {TABLE: [], SLOT: []}  # what was met of these, and how many
        self.sizes = {TABLE: 0, SLOT: 0}

    def release(self) -> None:
        for rows in (self.out, self.by_table, self.by_slot):
            if rows is not None:
                rows.release()

    def held_by_met(self) -> DataFrame:
        """(kind, key): all methods of the tables met."""
        if not self.known[TABLE]:
            return self.met.all().limit(0)
        return self._methods(self.by_table.entered(_union(self.known[TABLE]), self.sizes[TABLE]))

    @staticmethod
    def _methods(rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(FUNCTION).alias("kind"), F.col("dst").alias("key"))

    def follow(self, found: DataFrame, called: bool) -> None:
        """Goes on from ``found`` (kind, key) until nothing is new; called: methods of live tables need their slot called, else slots are not looked at."""
        while True:
            frontier, n = self.met.new(found)
            if not n:
                return
            sizes = {r.kind: r for r in frontier.groupBy("kind").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()}
            new, parts = {}, []
            for kind in (TABLE, SLOT):
                if kind in sizes:
                    new[kind] = cut(frontier.filter(F.col("kind") == kind).select("key"))
                    self.known[kind].append(new[kind])
                    self.sizes[kind] += sizes[kind].n
            if FUNCTION in sizes:
                it = sizes[FUNCTION]
                entered = self.out.entered(frontier.filter(F.col("kind") == FUNCTION).select("key"), it.n, (it.least, it.most))
                parts.append((entered if called else entered.filter(F.col("to_kind") != SLOT)).select(F.col("to_kind").alias("kind"), F.col("to").alias("key")))
            if not called and TABLE in new:
                parts.append(self._methods(self.by_table.entered(new[TABLE], sizes[TABLE].n)))
            for rows, own, other in ((self.by_table, TABLE, SLOT), (self.by_slot, SLOT, TABLE)) if called else ():
                if own in new and self.known[other]:
                    known = _union(self.known[other]).select(F.col("key").alias("other"))
                    parts.append(self._methods(rows.entered(new[own], sizes[own].n).join(F.broadcast(known) if self.sizes[other] <= graph.SMALL else known, "other", "left_semi")))
            if not parts:
                return
            found = _union(parts)


def labelled_walk(edges: DataFrame, seeds: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(key, word, bits): which labels reach each node, from one walk for all of them.

    seeds (key, label): where the walk of a label, a number from 0 on such as that of a binary,
    begins. A node's set is kept in words of 64 labels: bit label % 64 of the word label / 64.
    among (key, ...): only these nodes are asked for, and their other columns come between key and
    word. Rows with nulls and negative labels are ignored; words without a bit have no row.

    Where many nodes have seeds, what leads to what is found first, for all nodes at once and
    however many labels begin at them, and the labels are looked up by these pairs. Where that are
    more than ``SPREAD`` pairs for each seed, as on long chains, or where few nodes have seeds,
    sets of labels are walked instead.
    """
    with tidy_shuffles(edges.sparkSession):
        edges = stored(_long(edges, src="src", dst="dst"))
        given = seeds.select(F.col("key").cast("long").alias("key"), F.col("label").cast("long").alias("label")).filter("key is not null and label >= 0")
        begun = stored(given.select("key").distinct())
        pairs = _leading(edges, SPREAD * given.count()) if begun.count() * 4 >= edges.count() else None
        sets = _walked_sets(edges, given) if pairs is None else None
        discard(edges)
    if among is not None:
        among = among.withColumn("key", F.col("key").cast("long")).filter("key is not null").distinct()
    if pairs is None:
        return sets if among is None else among.join(sets, "key")
    itself = (begun if among is None else among.select("key").distinct()).select(F.col("key").alias("at"), "key")
    asked = pairs.select("at", "key").union(itself)
    if among is not None:
        asked = among.join(asked, "key")
    own = _words(given.repartition(_parts(given), "key")).withColumnRenamed("key", "at")  # lies as the pairs are dealt for the join
    return asked.join(own, "at").groupBy(*[c for c in asked.columns if c != "at"], "word").agg(F.bit_or("bits").alias("bits"))


def _words(labels: DataFrame) -> DataFrame:
    """(key, word, bits) of (key, label)."""
    bit = F.expr("shiftleft(1L, cast(label & 63 as int))")
    return labels.groupBy("key", F.shiftright("label", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _leading(edges: DataFrame, limit: int) -> DataFrame | None:
    """(at, key, hops): each node ``at`` with every other node ``key`` that it leads to, and how many edges apart; None where a round would bring more than ``limit`` pairs, beyond graph.SMALL.

    edges: distinct pairs (src, dst). A round doubles the distance: a pair between k and 2 k edges
    apart is one of exactly k edges and one of at most k. So rounds grow with the logarithm of the
    depth, and few pairs are met in several ways. What a round joins is counted before.
    """
    pairs, k = stored(edges.filter("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("key"), F.lit(1).alias("hops"))), 1
    while True:
        last = pairs.filter(F.col("hops") == k)
        ends, begins = last.groupBy("key").agg(F.count("*").alias("n")), pairs.groupBy(F.col("at").alias("key")).agg(F.count("*").cast("double").alias("m"))
        more = ends.join(begins, "key").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
        if not more:
            return pairs
        if more + pairs.count() > max(limit, graph.SMALL):
            discard(pairs)
            return None
        further = last.select("at", F.col("key").alias("mid")).join(pairs.select(F.col("at").alias("mid"), "key", "hops"), "mid").filter("at <> key").select("at", "key", F.col("hops") + k)
        old, pairs = pairs, stored(pairs.union(further).groupBy("at", "key").agg(F.min("hops").alias("hops")))
        discard(old)
        k *= 2


def _walked_sets(edges: DataFrame, given: DataFrame) -> DataFrame:
    """(key, word, bits): the sets of labels by a walk that carries them. The frontier has the bits that are new at a node, so a node is entered again when labels come later, but no label passes an edge, or a shortcut, twice."""
    merged = lambda df: df.groupBy("key", "word").agg(F.bit_or("bits").alias("bits"))
    frontier = stored(_words(given))
    n = frontier.count()
    few = n <= graph.SMALL  # shortcuts bring few steps, but each bit on several ways
    dealt = _Dealt((_with_shortcuts(edges) if few else edges).withColumnRenamed("src", "key"), ["key"], "dst")
    parts, old = [frontier], []
    while n:
        told = stored(merged(dealt.entered(frontier, n).select(F.col("dst").alias("key"), "word", "bits")))
        met = told.select("key", "word")
        # what was known of these: few of them are looked up where the parts lie, so that late steps don't move all sets
        had = _union(parts).join(F.broadcast(met) if told.count() <= graph.SMALL else met, ["key", "word"], "left_semi")
        both = told.select("key", "word", "bits", F.lit(0).cast("long").alias("known")).union(had.select("key", "word", F.lit(0).cast("long"), "bits"))
        rest = both.groupBy("key", "word").agg(F.bit_or("bits").bitwiseAND(F.bitwise_not(F.bit_or("known"))).alias("bits"))
        frontier = stored(rest.filter("bits <> 0"))
        n = frontier.count()
        discard(told, *old)
        parts, old = [*parts, frontier], []
        if len(parts) > graph.COMPACT:
            old, parts = parts, [stored(merged(_union(parts)))]
            discard(*old[:-1])
            old = old[-1:]  # the frontier, until it was entered
    dealt.release()
    return merged(_union(parts))


def _with_shortcuts(edges: DataFrame) -> DataFrame:
    """Distinct ``edges`` (src, dst) with pairs up to four edges apart, while there are few more of these: a walk then takes a quarter of the steps."""
    edges = cut(edges)
    for _ in range(2):
        onwards = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n"))
        if (edges.join(onwards, "dst").agg(F.sum("n")).first()[0] or 0) > 2 * edges.count():
            break
        further = edges.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        edges = cut(edges.union(further).distinct())
    return edges


def labels_of(sets: DataFrame) -> DataFrame:
    """(key, label): the labels of label sets (key, word, bits), a row each."""
    one = F.when(F.col("bits") < 0, WORD - 1).otherwise(F.expr("bit_count(bits - if(bits < 0, 0, 1))"))  # place of the only bit
    places = F.when(F.bit_count("bits") == 1, F.array(one)).otherwise(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("bits", k) == 1))
    return sets.select("key", F.explode(places).alias("place"), "word").select("key", (F.col("word") * WORD + F.col("place")).alias("label"))


def label_lists(sets: DataFrame) -> DataFrame:
    """(key, labels): the ascending labels of each key of label sets, as one array."""
    return labels_of(sets).groupBy("key").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def seeds_by_library(items: DataFrame, sets: DataFrame) -> DataFrame:
    """(krate, key, word, bits): public items of libraries that binaries reach, and which ones; the seeds of a library's own walk.

    items: (krate, key, is_public, in_library).
    """
    return library_items(items).join(sets, "key").select("krate", "key", "word", "bits")


def library_items(items: DataFrame) -> DataFrame:
    """(krate, key): public items of libraries. items: see seeds_by_library."""
    return items.filter("is_public and in_library").select("krate", "key")


def placed(items: DataFrame, partition: str) -> DataFrame:
    """(key, partition, n): each key in each partition, and how many items it is there."""
    return items.groupBy(F.col("key").cast("long").alias("key"), partition).agg(F.count("*").alias("n"))


def marks_by_label(items: DataFrame, sets: DataFrame, partition: str) -> DataFrame:
    """(partition, label, n_items, n_marked, skip): for each label, how many items of a partition it reaches; skip: all of them.

    Labels that reach nothing of a partition have no row. Where sets are those of a walk among
    ``placed`` items, they have what is asked of items and are not joined with them.
    """
    every = items.groupBy(partition).agg(F.count("*").alias("n_items"))
    at = sets if partition in sets.columns else placed(items, partition).join(sets, "key")
    marked = at.groupBy(partition, "word").agg(*[F.sum(F.getbit("bits", F.lit(k)) * F.col("n")).alias(str(k)) for k in range(WORD)])
    each = marked.select(partition, F.posexplode(F.array(*[F.col(f"`{k}`") for k in range(WORD)])).alias("place", "n_marked"), "word").filter("n_marked > 0")
    out = each.join(every, partition)
    return out.select(partition, (F.col("word") * WORD + F.col("place")).alias("label"), "n_items", "n_marked", (F.col("n_items") == F.col("n_marked")).alias("skip"))


def changed_walk(edges: DataFrame, reached: DataFrame, seeds: DataFrame, added: DataFrame, removed: DataFrame, removed_seeds: DataFrame | None = None) -> DataFrame:
    """(key): what ``seeds`` reach when edges are ``added`` and ``removed``, from what was reached before.

    edges, added, removed: (src, dst), edges being those before the change; reached (key): what was
    reached then; seeds (key): those after the change; removed_seeds (key): those that are none any
    more. An edge both added and removed stays or comes; removing what is not there and adding what is
    change nothing. Rows with nulls are ignored.

    Delete and rederive: what lies behind a removed edge or seed counts as lost, as far as it was
    reached; lost nodes with an edge from one that is not lost come back, with what they reach among
    the lost; then the walk goes on from what is new. Edges and reached nodes are read where they lie
    and joined with these few nodes, and are not shuffled up to ``graph.SMALL`` of them.
    """
    keys = lambda df: _long(df, key="key")
    added = cut(_long(added, src="src", dst="dst"))
    removed = cut(_long(removed, src="src", dst="dst").join(added, ["src", "dst"], "left_anti"))
    seeds = cut(keys(seeds))
    before = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src is not null and dst is not null")
    after = before.join(_small(removed), ["src", "dst"], "left_anti").union(added)
    reached = reached.select(F.col("key").cast("long").alias("key"))

    cut_off = _among(reached, removed.select("src", "dst"), "src").select(F.col("dst").alias("key"))
    if removed_seeds is not None:
        cut_off = cut_off.union(keys(removed_seeds))
    lost = cut(_walk(before, cut_off.join(seeds, "key", "left_anti"), within=reached, without=seeds))
    kept = reached.join(_small(lost), "key", "left_anti")
    held = after.join(_small(lost).select(F.col("key").alias("dst")), "dst", "left_semi")
    back = cut(_walk(after, _among(kept, cut(held), "src").select(F.col("dst").alias("key")), within=lost))
    now = kept.union(back)
    start = _among(now, added, "src").select(F.col("dst").alias("key")).union(seeds)
    return now.union(_walk(after, start, without=now))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed table, for every executor while its counted size allows."""
    return F.broadcast(df) if df.count() <= graph.SMALL else df


def _among(nodes: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """The rows of ``few``, a checkpointed table, whose ``column`` is one of the distinct ``nodes`` (key); nodes stay where they are while few are few."""
    own = nodes.select(F.col("key").alias(column))
    return own.join(F.broadcast(few), column).select(*few.columns) if few.count() <= graph.SMALL else few.join(own, column, "left_semi")


def _walk(edges: DataFrame, start: DataFrame, within: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(key): what ``start`` reaches, itself included, over nodes of ``within`` and none of ``without``; edges and these stay where they are."""
    met = _Met(["key"])
    found = start
    while True:
        if within is not None:
            found = _among(within, cut(found.distinct()), "key")
        if without is not None:
            found = cut(found.distinct())
            found = found.join(_small(cut(_among(without, found, "key"))), "key", "left_anti")
        frontier, n = met.new(found)
        if not n:
            return met.all()
        small = F.broadcast(frontier) if n <= graph.SMALL else frontier
        found = edges.join(small.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key"))
