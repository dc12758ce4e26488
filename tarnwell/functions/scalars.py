"""Scalar functions of the build domain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# Offset and prime of FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
# Fixed value: an include directive of a C source.
INCLUDE = r"""(?m)^\s*#include\s*[<"](.*?)[>"]"""
FEW = 16  # texts at or below which a step over all of them costs more than a loop


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """FNV-1a, 64 bits, of each text: one step a byte position over all texts that reach it, the longest by themselves."""
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    out = np.full(len(texts), FNV_OFFSET, np.uint64)
    ahead, at = size[order], 0
    while (n := int(np.searchsorted(-ahead, -at))) > FEW:  # texts longer than ``at``
        rows = order[:n]
        out[rows] = (out[rows] ^ flat[start[rows] + at]) * np.uint64(FNV_PRIME)
        at += 1
    for i in order[:n].tolist():
        h = int(out[i])
        for byte in texts[i][at:]:
            h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


@F.pandas_udf(StringType())
def fnv1a_hex(data: pd.Series) -> pd.Series:
    """FNV-1a of a string's UTF-8 bytes as 16 hex digits; null for null. Spark has no such hash."""
    known = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[known] = [f"{h:016x}" for h in fnv1a([x.encode() for x in data[known]]).tolist()]
    return out


def hex16(key: Column) -> Column:
    return F.lpad(F.lower(F.hex(key)), 16, "0")


def parse_hex(digits: Column) -> Column:
    """decimal(20,0) of up to 16 hex digits, blanks around them ignored; null for anything else."""
    text = F.trim(digits)
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, 10)).cast("decimal(20,0)")


def crate_name(name: Column) -> Column:
    return F.translate(name, "-", "_")


def without_version(unit: Column) -> Column:
    """Cut at the last dash if a digit follows it."""
    return F.regexp_replace(unit, r"-[0-9][^-]*$", "")


def includes(text: Column) -> Column:
    """Headers that a C source includes, in order."""
    return F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(1))


def frontmatter(text: Column) -> Column:
    """Manifest between --- fences at the head of a script, behind a first #! line and blank lines; null without."""
    pattern = r"(?s)^(?:#![^\n]*\n)?(?:[ \t]*\n)*---[^\n]*\n(.*?)(?:(?<=\n)|^)---[ \t]*(?:\n|$)"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def has_edition(manifest: Column) -> Column:
    return manifest.rlike(r"(?m)^\s*edition")


def with_edition(manifest: Column, edition: str = "2021") -> Column:
    """The manifest with an edition line under [package], which is put first if missing."""
    line = f'edition = "{edition}"\n'
    under = F.regexp_replace(manifest, r"(?m)^(\s*\[package\][^\n]*\n)", f"$1{line}")
    return F.when(has_edition(manifest), manifest).when(manifest.rlike(r"(?m)^\s*\[package\][^\n]*\n"), under).otherwise(F.concat(F.lit(f"[package]\n{line}"), manifest))


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts that decide an artefact, each with its length before it; a null is told from an empty part."""
    text = [p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *[F.when(t.isNull(), "-").otherwise(F.concat(F.length(t), F.lit(":"), t)) for t in text]), 256)


def script_cache_path(path: Column, root: str = "/tmp", prefix: str = "script-") -> Column:
    """The cache folder of a script by the hash of its path; null for null."""
    return F.concat(F.lit(f"{root.rstrip('/')}/{prefix}"), fnv1a_hex(path))


def plan_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


def skip_decision(stubs: Column, total: Column, threshold: str | None = None) -> Column:
    """skip or cut.

    threshold: None: skip if nothing would be cut, or under five stubs that are under 2 % of all;
    'auto': skip if nothing would be cut; '0' or 'never': never skip; a number: skip below it.
    """
    if threshold is None:
        few = (stubs == 0) | ((stubs < 5) & (stubs < 0.02 * total))
    elif threshold == "auto":
        few = stubs == 0
    elif threshold in ("0", "never"):
        few = F.lit(False)
    elif threshold.isdecimal():
        few = stubs < int(threshold)
    else:
        raise ValueError(f"not a threshold: {threshold}")
    return F.when(few, "skip").otherwise("cut")


def daemon_decision(cached: Column, files: Column, lines: Column) -> Column:
    return F.coalesce(cached, (files > 150) & (lines > 150000))


def route(path: Column, probe: Column) -> Column:
    """Where a compile call goes: probes to the compiler, registry paths to the cache, local ones to the driver."""
    return F.when(probe, "compiler").when(path.rlike(r"/(registry|git|vendor)/"), "cache").otherwise("driver")
