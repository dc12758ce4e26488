"""Reachability and what follows from it: seeds, safe elimination, reduction by partition, orders on DAGs.

Nodes are BIGINT keys, edges rows (src, dst). Loops run on the driver, one small distributed plan a
step; each step's result is checkpointed, so plans stay small and survive lost executors. The
number of steps is the depth of the graph.

Edges are dealt once by the end at which steps enter them, with a few salts so that a hub's edges
lie in several partitions, and stay there: what a step moves is its frontier and what it finds.
Visited nodes keep the partitioning they were found with, so they are not moved again either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored
from ..plans.numbering import numbered
from . import blocks

SMALL = 1_000_000  # rows of a counted, checkpointed table up to which it is handed to every executor (tens of MB)
COMPACT = 8  # steps after which the parts of the visited set are written together
SALTS = 8  # partitions that the edges of one node are dealt to
HUB = 100_000  # edges of a node beyond which the walks of ``walks`` deal them so


def pack_key(krate: Column, index: Column) -> Column:
    """BIGINT key of a node: partition number in the upper half, index in the lower."""
    return F.shiftleft(krate.cast("long"), 32).bitwiseOR(index.cast("long"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(edges: DataFrame, by: str) -> DataFrame:
    """Distinct edges (src, dst, salt) without nulls, checkpointed, dealt by (``by``, salt) and sorted so."""
    other = "dst" if by == "src" else "src"
    rows = edges.filter("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return cut(salted.repartition(_parts(edges), by, "salt").sortWithinPartitions(by, "salt"))


def _step(edges: DataFrame, by: str, nodes: DataFrame, rows: int) -> DataFrame:
    """``edges`` (see _dealt) that ``nodes`` (key, ...), of counted size ``rows``, enter at ``by``, with the columns of both."""
    if rows <= SMALL:
        return edges.join(F.broadcast(nodes), F.col(by) == F.col("key"))
    spread = nodes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.join(spread, (F.col(by) == F.col("key")) & (F.col("salt") == F.col("s"))).drop("s")


def reachable(edges: DataFrame, seeds: DataFrame, expand: DataFrame | None = None) -> DataFrame:
    """(key): everything reachable from ``seeds`` (key), seeds included; targets that are no node are marked too.

    expand: if given, only nodes in it (key) are expanded further. Cycles end; null keys are ignored.
    """
    if expand is not None:
        edges = edges.join(expand.select(F.col("key").alias("src")), "src", "left_semi")
    edges = _dealt(edges, "src")
    by_key = lambda df: df.repartition(_parts(edges), "key").sortWithinPartitions("key")
    frontier = cut(by_key(seeds.filter("key is not null").select(F.col("key").cast("long").alias("key")).distinct()))
    parts, met = [frontier], 0
    while n := frontier.count():
        met += n
        found = _step(edges, "src", frontier, n).select(F.col("dst").alias("key")).distinct()
        if met <= SMALL:  # a counted size; beyond it, parts lie dealt and sorted by key, as what is found
            frontier = cut(found.join(F.broadcast(_union(parts)), "key", "left_anti"))
        else:
            for part in parts:
                found = found.join(part, "key", "left_anti")
            frontier = cut(found.sortWithinPartitions("key"))
        parts.append(frontier)
        if len(parts) > COMPACT and met > SMALL:
            parts = [cut(by_key(_union(parts)))]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def collect_seeds(items: DataFrame, vtable_traits: DataFrame, address_taken: DataFrame) -> DataFrame:
    """(key): items exported or entered from outside, local methods of dispatched traits, functions whose address is taken."""
    outside = items.filter("(in_reachable_set and is_local) or is_entry").select("key")
    methods = items.filter("is_local and trait_dyn_compatible").join(vtable_traits, "trait_key", "left_semi").select("key")
    return outside.union(methods).union(address_taken.select("key")).distinct()


def locally_safe(items: DataFrame, vtable_traits: DataFrame) -> DataFrame:
    """Items that may go when nothing reaches them; an unknown attribute keeps its item."""
    flags = ("no_mangle", "used_linker", "has_symbol_name", "has_linkage", "is_drop_impl", "is_entry", "requires_mono", "is_async")
    safe = F.coalesce(F.col("is_local"), F.lit(False)) & F.coalesce(F.col("kind").isin("Fn", "AssocFn"), F.lit(False))
    for flag in flags:
        safe = safe & ~F.coalesce(F.col(flag), F.lit(True))
    held = vtable_traits.select(F.col("trait_key").alias("held"))
    dispatched = (F.col("trait_key") == F.col("held")) & F.coalesce(F.col("trait_dyn_compatible"), F.lit(True))
    return items.filter(safe).join(held, dispatched, "left_anti")


def eliminable(items: DataFrame, reached: DataFrame, mono_items: DataFrame, vtable_traits: DataFrame) -> DataFrame:
    """(key): function-like local items that nothing reaches, that are not generated, and that are safe."""
    fns = items.filter("is_local and is_fn_like")
    return locally_safe(fns, vtable_traits).join(reached, "key", "left_anti").join(mono_items, "key", "left_anti").select("key")


def seeded_elimination(items: DataFrame, keep: DataFrame, vtable_traits: DataFrame) -> DataFrame:
    """(key): safe function-like items whose stable id (scid, lo) is not in ``keep``; no graph walk."""
    return locally_safe(items.filter("is_local and is_fn_like"), vtable_traits).join(keep, ["scid", "lo"], "left_anti").select("key")


def unreached_exports(items: DataFrame, reached: DataFrame) -> DataFrame:
    """Invariant: local items of the export set that are not reached; must be empty."""
    return items.filter("in_reachable_set and is_local").select("key").join(reached, "key", "left_anti")


def reduction_by(items: DataFrame, reached: DataFrame, partition: str) -> DataFrame:
    """(partition, n_items, n_marked, removed, percent_removed, skip): what remains of each partition; skip: nothing to cut."""
    marked = items.join(reached.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    out = marked.groupBy(partition).agg(F.count("*").alias("n_items"), F.count("hit").alias("n_marked"))
    removed = F.col("n_items") - F.col("n_marked")
    return out.select(partition, "n_items", "n_marked", removed.alias("removed"), (100.0 * removed / F.col("n_items")).alias("percent_removed"), (removed == 0).alias("skip"))


def trait_call_edges(calls: DataFrame, impls: DataFrame) -> DataFrame:
    """(src, dst): calls (src, trait_method, self_type) resolved to implementations (trait_method, self_type, method)."""
    return calls.join(impls, ["trait_method", "self_type"]).select("src", F.col("method").alias("dst")).distinct()


def keep_export(reached: DataFrame, items: DataFrame, local: int) -> DataFrame:
    """(scid, lo) of reached items of other partitions than ``local``, for one keep file each."""
    return items.filter(F.col("krate") != local).join(reached, "key", "left_semi").select("scid", "lo").distinct()


def codegen_units(units: DataFrame, gone: DataFrame) -> DataFrame:
    """(cgu, n_items, size) after local eliminable functions that are not inlined are dropped."""
    drop = units.filter("is_fn and is_local and not inlined").join(gone.withColumnRenamed("key", "item"), "item", "left_semi").select("cgu", "item")
    return units.join(drop, ["cgu", "item"], "left_anti").groupBy("cgu").agg(F.count("*").alias("n_items"), F.sum("size").alias("size"))


def _peeled(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, weight, level, cp) of the nodes (key, weight) not on or behind a cycle; cp: weight plus the largest cp of the dependencies.

    Every step peels the nodes all of whose dependencies are peeled. Dependencies are counted once;
    a step enters those on what the step before peeled, and carries on with nodes that some of
    their dependencies were peeled of and some not.
    """
    edges = _dealt(deps, "dst")
    nodes = cut(nodes.filter("key is not null").select(F.col("key").cast("long").alias("key"), F.col("weight").cast("double").alias("weight")).dropDuplicates(["key"]))
    need = edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("need"))
    need = cut(nodes.join(need, "key").repartition(_parts(deps), "key").sortWithinPartitions("key"))
    ready = cut(nodes.join(edges.select(F.col("src").alias("key")), "key", "left_anti").select("key", "weight", F.lit(0).alias("level"), F.col("weight").alias("cp")))
    out, partly, level = ready, need.select("key", "weight", "need", F.lit(None).cast("double").alias("best")).limit(0), 0
    while n := ready.count():
        level += 1
        told = _step(edges, "dst", ready.select("key", "cp"), n).groupBy(F.col("src").alias("key")).agg(F.count("*").alias("met"), F.max("cp").alias("best"))
        new = told.join(need, "key").select("key", "weight", (F.col("need") - F.col("met")).alias("need"), "best")
        known = partly.join(told.select("key", "met", F.col("best").alias("more")), "key", "left")
        kept = known.select("key", "weight", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), F.greatest("best", "more").alias("best"))
        moved = cut(kept.unionByName(new.join(partly.select("key"), "key", "left_anti")) if level > 1 else new)
        ready = moved.filter("need = 0").select("key", "weight", F.lit(level).alias("level"), (F.col("weight") + F.col("best")).alias("cp"))
        partly = moved.filter("need > 0")
        out = out.union(ready)
        if level % COMPACT == 0:
            out = cut(out)
    return out


def topological_levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, level): 0 for nodes without dependencies, else one above the highest dependency; null on or behind a cycle.

    deps: src depends on dst.
    """
    keys = nodes.select("key").filter("key is not null").distinct()
    return keys.join(_peeled(keys.withColumn("weight", F.lit(0.0)), deps).select("key", "level"), "key", "left")


def critical_path(weights: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, weight, cp): cp = weight + largest cp of the dependencies, bottom up; nodes on or behind a cycle are left out."""
    return _peeled(weights, deps).select("key", "weight", "cp")


def codegened(items: DataFrame, gone: DataFrame, mono_items: DataFrame) -> DataFrame:
    """(key, codegened): false for local items in ``gone``, else whether the item is generated."""
    marked = items.join(gone.select("key", F.lit(True).alias("gone")).distinct(), "key", "left").join(mono_items.select("key", F.lit(True).alias("mono")).distinct(), "key", "left")
    return marked.select("key", F.when(F.col("is_local") & F.col("gone").isNotNull(), False).otherwise(F.col("mono").isNotNull()).alias("codegened"))


@dataclass(frozen=True)
class Analysis:
    """Results of ``analyse``; reached and seeds are None where no walk was made."""

    gone: DataFrame
    reached: DataFrame | None = None
    seeds: DataFrame | None = None


def analyse(items: DataFrame, edges: DataFrame, vtable_traits: DataFrame, address_taken: DataFrame, mono_items: DataFrame, keep: DataFrame | None = None) -> Analysis:
    """The whole analysis of one partition: with a keep table no graph is walked; without an entry nothing goes."""
    if keep is not None:
        return Analysis(seeded_elimination(items, keep, vtable_traits))
    if items.filter("is_entry").isEmpty():
        return Analysis(items.select("key").limit(0))
    seeds = collect_seeds(items, vtable_traits, address_taken)
    reached = reachable(edges, seeds)
    return Analysis(eliminable(items, reached, mono_items, vtable_traits), reached, seeds)


def feedback_seeds(keep: DataFrame, items: DataFrame) -> DataFrame:
    """(key): items of a library that another partition's walk reached, found by stable id (scid, lo); seeds of its own walk."""
    return items.join(keep, ["scid", "lo"], "left_semi").select("key").distinct()


def forced_elimination(items: DataFrame, reached: DataFrame, forced: DataFrame, mono_items: DataFrame, vtable_traits: DataFrame) -> DataFrame:
    """(key): ``eliminable`` of a second pass, with the first pass's generated set (key) kept by force."""
    return eliminable(items, reached.select("key").union(forced.select("key")).distinct(), mono_items, vtable_traits)


def phase_graph(units: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, unit, phase) and deps (src, dst) of a build in which libraries are generated after the binaries' analysis.

    units: (unit, is_binary), unit below 2**31; phase 0: analysis, 1: generation, 2: a barrier that is
    passed when every binary that depends on the unit, directly or not, and the unit itself if it is
    one, is analysed; key = unit * 4 + phase. Analysis follows the analysis of dependencies,
    generation follows the own analysis and, for libraries, the own barrier; a barrier follows those
    of the units that depend on it. So waits take a row for each dependency, not one for each pair of
    a library and a binary, and no cycle of its own arises.
    """
    at = lambda unit, phase: F.col(unit).cast("long") * 4 + phase
    pair = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    phase = units.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("phase"), F.col("unit").cast("long").alias("unit"))
    nodes = phase.select((F.col("unit") * 4 + F.col("phase")).alias("key"), "unit", "phase")
    own = pair(units, at("unit", 1), at("unit", 0)).union(pair(units.filter("not is_binary"), at("unit", 1), at("unit", 2))).union(pair(units.filter("is_binary"), at("unit", 2), at("unit", 0)))
    between = pair(deps, at("src", 0), at("dst", 0)).union(pair(deps, at("dst", 2), at("src", 2)))
    return nodes, own.union(between).distinct()


def degrees(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, n_out, n_in): distinct dependencies of each node, and nodes that depend on it; counted before the shuffle."""
    ends = deps.select("src", "dst").distinct().select(F.explode(F.array(F.struct(F.col("src").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    counts = ends.groupBy("key").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return nodes.select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def strong_components(deps: DataFrame) -> DataFrame:
    """(key, component): the nodes on cycles, with the largest key of their strongly connected component.

    Components inside blocks of keys are contracted by tasks first, see ``blocks``; what is left are
    edges on which cycles between blocks can lie. Where keys follow the graph these are few.
    """
    given = deps.filter("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    left = stored(given.distinct())
    loops = left.filter("src = dst").select(F.col("src").alias("key"), F.col("src").alias("component"))
    inner, rest = blocks.contracted(left.filter("src <> dst"))
    out = loops.union(inner)
    if not rest.isEmpty():
        wide = _coloured(cut(rest))
        moved = inner.join(wide.select(F.col("key").alias("component"), F.col("component").alias("wider")), "component").select("key", "wider")
        out = out.union(wide).union(moved)
    return out.groupBy("key").agg(F.max("component").alias("component"))


def _coloured(left: DataFrame) -> DataFrame:
    """(key, component) of the nodes on cycles of the distinct edges ``left`` without loops.

    Nodes that cannot lie on a cycle are peeled from both ends. Of what is left, every node takes the
    largest key that reaches it; those that reach this key again along nodes with the same one are
    its component. The rest goes into the next round.
    """
    out = left.select(F.col("src").alias("key"), F.col("src").alias("component")).limit(0)
    for here, there in (("src", "dst"), ("dst", "src")):
        turned = left.select(F.col(here).alias("src"), F.col(there).alias("dst"))
        nodes = turned.select(F.col("src").alias("key")).union(turned.select("dst")).distinct()
        left = cut(_inside(left, topological_levels(nodes, turned).filter("level is null").select("key")))
    while not left.isEmpty():
        colour = _largest_reaching(left)
        same = left.join(colour.select(F.col("key").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("key").alias("dst"), F.col("colour").alias("b")), "dst")
        back = same.filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        met = reachable(back, colour.filter("key = colour").select("key"))
        found = cut(met.join(colour, "key").select("key", F.col("colour").alias("component")))
        out = cut(out.union(found.join(found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"), "component").select("key", "component")))
        left = cut(_inside(left, colour.join(found, "key", "left_anti").select("key")))
    return out


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes`` (key)."""
    return edges.join(nodes.select(F.col("key").alias("src")), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst")


def _largest_reaching(edges: DataFrame) -> DataFrame:
    """(key, colour): the largest key from which a node is reached, its own included; only nodes that changed are followed and written."""
    dealt = _dealt(edges, "src")
    few = dealt.count() <= SMALL  # then what a step tells is no more
    nodes = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    changed = cut(nodes.withColumn("colour", F.col("key")))
    latest = lambda parts: _union(parts).groupBy("key").agg(F.max("colour").alias("colour"))
    parts = [changed]
    while n := changed.count():
        told = _step(dealt, "src", changed, n).groupBy(F.col("dst").alias("key")).agg(F.max("colour").alias("more"))
        known = _union(parts).join(F.broadcast(told) if few else told, "key").groupBy("key").agg(F.max("colour").alias("had"), F.max("more").alias("colour"))
        changed = cut(known.filter("colour > had").select("key", "colour"))
        parts.append(changed)
        if len(parts) > COMPACT:
            parts = [cut(latest(parts))]
    return latest(parts)


def cyclic(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(key): nodes that lie on a cycle, a dependency on oneself included."""
    return nodes.select("key").distinct().join(strong_components(deps).select("key"), "key", "left_semi")


def without_cycles(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """``deps`` (src, dst) made acyclic: of those inside a cycle's strongly connected component, only dependencies on a smaller key stay."""
    held = cut(strong_components(deps).join(nodes.select("key").distinct(), "key", "left_semi"))
    a = held.select(F.col("key").alias("src"), F.col("component").alias("a"))
    b = held.select(F.col("key").alias("dst"), F.col("component").alias("b"))
    return deps.join(a, "src", "left").join(b, "dst", "left").filter("not (a <=> b) or a is null or dst < src").select("src", "dst")


def independent_parts(edges: DataFrame, nodes: DataFrame, max_steps: int = 60) -> DataFrame:
    """(key, part): the parts of ``nodes`` (key), such as a reachable set, that share no edge and can be built apart.

    part: the smallest key. Edges count in both directions, those with an end outside ``nodes`` not.
    Every step points nodes at the smallest neighbour known, then neighbours at each other, until
    each part is a star; the number of steps grows with the logarithm of the longest chain.
    """
    own = _inside(edges, cut(nodes.filter("key is not null").select("key").distinct()))
    now = cut(own.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(max_steps):
        ends = now.select(F.col("u").alias("key"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("key").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").isEmpty():
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(wide.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least).filter("u <> v").distinct())
    else:
        raise RuntimeError(f"parts did not settle in {max_steps} steps")
    return nodes.select("key").filter("key is not null").distinct().join(now.select(F.col("u").alias("key"), "v"), "key", "left").select("key", F.coalesce("v", "key").alias("part"))


def cross_partition_seeds(items: DataFrame) -> DataFrame:
    """(key): where a walk over the union of all partitions starts: entries of binaries, public items of libraries, Drop impls, statics.

    items: (key, is_entry, is_public, in_library, is_drop_impl, kind); a null attribute is no reason to start.
    """
    return items.filter("is_entry or (is_public and in_library) or is_drop_impl or kind = 'Static'").select("key").distinct()


def marks_by_partition(items: DataFrame, reached: DataFrame) -> DataFrame:
    """(krate, key, is_seed): reached items of each partition; is_seed: public ones of libraries, the seeds of their own walk."""
    public = F.coalesce(F.col("is_public") & F.col("in_library"), F.lit(False))
    return items.join(reached, "key", "left_semi").select("krate", "key", public.alias("is_seed"))


def topological_order(nodes: DataFrame, deps: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(key, position): dependencies first, equals by key, from 1; ``roots`` (key) take a place and are left out, as are cycles."""
    placed = topological_levels(nodes, deps).filter("level is not null")
    out = numbered(placed, ["level", "key"], "position")
    return (out if roots is None else out.join(roots, "key", "left_anti")).select("key", "position")


def admission(paths: DataFrame, slots: int) -> DataFrame:
    """(key, cp, rank, wave): in what order and in which wave of ``slots`` units are admitted, longest critical path first; ties by key."""
    ranked = numbered(paths.select("key", "cp", (-F.col("cp")).alias("less")), ["less", "key"], "rank")
    return ranked.select("key", "cp", "rank", (F.floor((F.col("rank") - 1) / F.lit(slots)) + 1).alias("wave"))


def scheduled(units: DataFrame, source_col: str = "source") -> DataFrame:
    """Units that the scheduler sees: those whose source is not a registry; a null source is local."""
    return units.filter(~F.coalesce(F.col(source_col).startswith("registry"), F.lit(False)))


def with_tier(units: DataFrame, tiers: DataFrame, crate: str = "crate") -> DataFrame:
    """``units`` with the smallest tier that holds their crate (crate, tier); null without one."""
    least = tiers.groupBy(crate).agg(F.min("tier").alias("tier"))
    return units.drop("tier").join(least, crate, "left") if "tier" in units.columns else units.join(least, crate, "left")


def weight_ms(size_bytes: Column) -> Column:
    """Estimated build weight: a millisecond for 350 bytes, from 100 to 60,000."""
    return F.least(F.greatest(size_bytes / 350.0, F.lit(100.0)), F.lit(60000.0))


def greedy_overlap_order(needs: DataFrame) -> list[str]:
    """Projects in build order from (project, dep, weight): heaviest first, then most weight in common with what is built.

    Ties go by name. The project list is a stated, small set, and greedy choice takes a step a
    project; a step adds up, on executors, what the dependencies that it builds first bring to each project.
    """
    needs = cut(needs.dropDuplicates(["project", "dep"]).repartition("dep"))
    total = {r.project: r.w for r in needs.groupBy("project").agg(F.sum("weight").alias("w")).collect()}
    common = dict(total)
    order: list[str] = []
    built = needs.select("dep").limit(0)
    while total:
        name = min(total, key=lambda p: (-common.get(p, 0.0), p))
        common = {} if not order else common
        order.append(name)
        del total[name]
        if total:
            new = cut(needs.filter(F.col("project") == name).select("dep").join(built, "dep", "left_anti"))
            for r in needs.join(new, "dep", "left_semi").groupBy("project").agg(F.sum("weight").alias("w")).collect():
                common[r.project] = common.get(r.project, 0.0) + r.w
            built = cut(built.union(new))
    return order
