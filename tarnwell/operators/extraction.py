"""Edges, address-taken functions and dispatched traits, read off tables of compiled bodies.

A compiler's dump is taken as tables, one row a fact; bodies that could not be read have no rows and
so add nothing. Nodes are BIGINT keys. Everything is a projection but the walks over allocations
and types, which are reachability with stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reachable

# Kinds of right-hand sides by how many of their operands count; others have none.
ONE_OPERAND = ("Use", "Repeat", "Cast", "UnaryOp", "ShallowInitBox")
TWO_OPERANDS = ("BinaryOp",)
ALL_OPERANDS = ("Aggregate",)
# What a statement may construct, what a cast may take the address of.
CLOSURES = ("closure", "coroutine", "coroutine_closure")
POINTER_CASTS = ("ReifyFnPointer", "ClosureFnPointer")
VALUES_WITH_MEMORY = ("Indirect", "Slice", "Pointer")


def _counted() -> Column:
    """The operands that count of a statement; [] for a null list or an rvalue that is none of the listed kinds."""
    most = F.when(F.col("rvalue").isin(*ONE_OPERAND), 1).when(F.col("rvalue").isin(*TWO_OPERANDS), 2).when(F.col("rvalue").isin(*ALL_OPERANDS), F.size("operands")).otherwise(0)
    return F.coalesce(F.slice("operands", F.lit(1), F.greatest(most, F.lit(0))), F.array())


def operands(statements: DataFrame) -> DataFrame:
    """(src, kind, target): the operands that count of each statement (src, rvalue, operands array<struct<kind, target>>)."""
    return statements.select("src", F.explode(_counted()).alias("x")).select("src", "x.kind", "x.target")


def body_edges(statements: DataFrame) -> DataFrame:
    """(src, dst): calls, functions among a call's arguments, constructed closures, and functions named as a value in an assignment.

    statements: (src, kind, target, rvalue, operands); kind is call, whose operands are its arguments,
    assign or one of the closures. One pass over the table.
    """
    functions = lambda some: F.transform(F.filter(some, lambda x: x["kind"] == "fn"), lambda x: x["target"])
    called = F.array_append(F.coalesce(functions(F.col("operands")), F.array()), F.col("target"))
    targets = F.when(F.col("kind") == "call", called).when(F.col("kind").isin(*CLOSURES), F.array("target")).when(F.col("kind") == "assign", functions(_counted()))
    return statements.select("src", F.explode(targets).alias("dst")).filter("dst is not null").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets, n): distinct targets in order; for output, as one hub's list is one row."""
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"), F.count("*").alias("n"))


def value_allocations(values: DataFrame) -> DataFrame:
    """(owner, id): allocations that a constant's value (owner, kind, prov array<long>) points to; other kinds have none."""
    return values.filter(F.col("kind").isin(*VALUES_WITH_MEMORY)).select("owner", F.explode("prov").alias("id")).distinct()


def constant_allocations(constants: DataFrame, values: DataFrame, allocs: DataFrame, alloc_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trait_key) of vtables and (key) of functions that constants and statics hold, directly or through memory.

    constants: (owner, is_generic, failed), of which generic ones and those that failed to evaluate are
    skipped, nulls too. allocs: (id, kind, target), alloc_edges: (src, dst); only Memory is walked on.
    """
    usable = constants.filter("not is_generic and not failed").select("owner")
    roots = value_allocations(values).join(usable, "owner", "left_semi").select(F.col("id").alias("key"))
    memory = allocs.filter("kind = 'Memory'").select(F.col("id").alias("key"))
    met = allocs.join(reachable(alloc_edges, roots, expand=memory), F.col("id") == F.col("key"), "left_semi").filter("target is not null")
    traits = met.filter("kind = 'VTable'").select(F.col("target").alias("trait_key")).distinct()
    return traits, met.filter("kind = 'Function'").select(F.col("target").alias("key")).distinct()


def cast_facts(casts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type_id) that an Unsize cast makes dynamic, and (key) of functions cast to pointers, from casts (kind, target, is_fn, type_id)."""
    dynamic = casts.filter("kind = 'Unsize' and type_id is not null").select("type_id").distinct()
    taken = casts.filter(F.col("kind").isin(*POINTER_CASTS) & F.col("is_fn") & F.col("target").isNotNull()).select(F.col("target").alias("key"))
    return dynamic, taken.distinct()


def asm_symbols(asm_operands: DataFrame) -> DataFrame:
    """(key): functions that inline assembly names (kind, target)."""
    return asm_operands.filter("kind = 'SymFn' and target is not null").select(F.col("target").alias("key")).distinct()


def dynamic_traits(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """(trait_key): principal traits of the dynamic types among ``wanted`` (type_id), seen through references and raw pointers.

    types: (type_id, kind, principal, inner). Dynamic types without a principal trait give nothing.
    """
    inner = types.filter("kind in ('Ref', 'RawPtr') and inner is not null").select(F.col("type_id").alias("src"), F.col("inner").alias("dst"))
    met = reachable(inner, wanted.select(F.col("type_id").alias("key")))
    return types.filter("kind = 'Dynamic' and principal is not null").join(met, F.col("type_id") == F.col("key"), "left_semi").select(F.col("principal").alias("trait_key")).distinct()
