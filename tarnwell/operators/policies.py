"""Policies of elimination: extra rules that keep items, levels of deletion, feature flags.

The base rules are ``graph.locally_safe``. A policy only adds reasons to keep; an unknown attribute
is such a reason.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import locally_safe

# Optional rules, each a Boolean column that keeps its item.
CHECKLIST = ("is_public_in_lib", "is_test", "is_unsafe", "has_dynamic_signature")
PROPOSED = ("is_weak_or_allocator", "has_track_caller", "is_coroutine", "in_proc_macro", "inlinable_across")
# What each level of deletion may touch.
LEVEL_TEXT = {
    0: "nothing is deleted",
    1: "private functions, verified",
    2: "all private items, verified",
    3: "also what the graph shows unreached, verified",
    4: "whatever the graph shows unreached",
}


@dataclass(frozen=True)
class Policy:
    """keep: columns of CHECKLIST and PROPOSED that keep an item. level: see LEVEL_TEXT. features: switched on by name."""

    keep: tuple[str, ...] = ()
    level: int = 3
    features: frozenset[str] = field(default_factory=frozenset)


def default_level(local_registry: bool = False) -> int:
    """1 with a local registry, where deleting too much costs more, else 3."""
    return 1 if local_registry else 3


def with_flags(policy: Policy, flags: Iterable[str], presets: dict[int, Iterable[str]] | None = None) -> Policy:
    """``policy`` after command-line flags in their order: -f<name>, -fno-<name>, -O<level>, -O (4).

    presets: features that a level brings; they are added to those switched on by name. Other flags
    raise ValueError.
    """
    features, level = set(policy.features), policy.level
    for flag in flags:
        if flag.startswith("-fno-") and len(flag) > 5:
            features.discard(flag[5:])
        elif flag.startswith("-f") and len(flag) > 2:
            features.add(flag[2:])
        elif flag == "-O":
            level = 4
        elif flag.startswith("-O") and flag[2:].isdecimal() and int(flag[2:]) in LEVEL_TEXT:
            level = int(flag[2:])
        else:
            raise ValueError(f"not a flag: {flag}")
    return Policy(policy.keep, level, frozenset(features | set((presets or {}).get(level, ()))))


def resolved_flags(rows: DataFrame, key: str, flags: str, local_registry: str, presets: dict[int, Iterable[str]] | None = None) -> DataFrame:
    """(key, level, features): what the flags of each row resolve to, as ``with_flags`` does from the default level.

    flags: flags in their order, separated by blanks; null or blank: none. local_registry: boolean, null
    is false. features: sorted names, comma-joined. A flag that is none fails the query. Of each name
    the last flag counts, so a row's flags are taken apart and put together by built-in functions alone.
    """
    word = F.filter(F.split(F.coalesce(F.col(flags), F.lit("")), r"\s+"), lambda x: x != "")
    each = rows.select(key, F.posexplode(word).alias("n", "flag"))
    off, on = F.regexp_extract("flag", "^-fno-(.+)$", 1), F.regexp_extract("flag", "^-f(.+)$", 1)
    level = F.when(F.col("flag") == "-O", "4").otherwise(F.regexp_extract("flag", "^-O([0-9]+)$", 1))
    known = F.when((off != "") | (on != ""), F.lit(None).cast("string")).when(level.isin(*map(str, LEVEL_TEXT)), level).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), "flag")))
    parts = each.select(key, "n", F.when(off != "", off).otherwise(on).alias("name"), (off == "").alias("on"), known.cast("int").alias("level"))
    last = parts.filter("name <> ''").groupBy(key, "name").agg(F.max_by("on", "n").alias("on")).filter("on").groupBy(key).agg(F.collect_set("name").alias("names"))
    levels = parts.filter("level is not null").groupBy(key).agg(F.max_by("level", "n").alias("level"))
    out = rows.select(key, F.when(F.coalesce(F.col(local_registry), F.lit(False)), default_level(True)).otherwise(default_level()).alias("first")).join(levels, key, "left").join(last, key, "left")
    out = out.select(key, F.coalesce("level", "first").alias("level"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    brought = F.array().cast("array<string>")
    for number, names in (presets or {}).items():
        brought = F.when(F.col("level") == number, F.array(*map(F.lit, names))).otherwise(brought)
    return out.select(key, "level", F.array_join(F.array_sort(F.array_union("names", brought)), ",").alias("features"))


def may_go(policy: Policy) -> Column:
    """Whether none of the policy's optional rules keeps an item; null attributes keep it."""
    out = F.lit(True)
    for name in policy.keep:
        if name not in CHECKLIST + PROPOSED:
            raise ValueError(f"not a rule: {name}")
        out = out & ~F.coalesce(F.col(name), F.lit(True))
    return out


def deletable(items: DataFrame, reached: DataFrame, mono_items: DataFrame, vtable_traits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(key) of items that the policy's level deletes, each of them unreached.

    Levels 1 to 3 verify: what is generated (mono_items) and what the base rules keep stays. Level 1
    takes private functions, 2 private items of any kind, 3 public functions as well. Level 4 trusts
    the graph: every local item that is not reached. items need is_public for levels 1 to 3.
    """
    unreached = items.filter(F.coalesce("is_local", F.lit(False)) & may_go(policy)).join(reached, "key", "left_anti")
    if policy.level == 0:
        return unreached.select("key").limit(0)
    if policy.level == 4:
        return unreached.select("key")
    private, function = ~F.coalesce("is_public", F.lit(True)), F.coalesce("is_fn_like", F.lit(False))
    functions = locally_safe(unreached.filter(function if policy.level == 3 else function & private), vtable_traits).select("key")
    if policy.level > 1:
        functions = functions.union(unreached.filter(private & ~function & (F.col("kind") != "Impl")).select("key"))
    return functions.join(mono_items, "key", "left_anti")


def unlinked(items: DataFrame, symbols: DataFrame, crates_with_scripts: DataFrame) -> DataFrame:
    """(key): functions whose symbol is not linked, that implement no trait, in crates without a build script.

    items: (key, symbol, crate, is_trait_impl, is_fn_like); symbols: (symbol); crates_with_scripts:
    (crate). A null symbol, crate or attribute keeps its item.
    """
    open_ = items.filter("is_fn_like and not is_trait_impl and symbol is not null and crate is not null")
    return open_.join(symbols, "symbol", "left_anti").join(crates_with_scripts, "crate", "left_anti").select("key")


def emitted_keep(items: DataFrame, mono_items: DataFrame, vtable_traits: DataFrame) -> DataFrame:
    """(scid, lo): function-like local items that are generated or that the base rules keep, for a keep file."""
    fns = items.filter("is_local and is_fn_like")
    goes = locally_safe(fns, vtable_traits).join(mono_items, "key", "left_anti").select("key")
    return fns.join(goes, "key", "left_anti").select("scid", "lo").distinct()
