"""Text scans: frequencies of patterns, log segments, sections, item lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIAGNOSTIC = r"^(warning:|error:|error\[E)"


def lines_of(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, n, line): the lines of each text, numbered from 0."""
    return texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))


def pattern_frequency(texts: DataFrame, pattern: str, group: int = 0, most: int = 10, text_col: str = "text", drop: str | None = None) -> DataFrame:
    """(item, n): the most frequent matches, equals by name; drop: a pattern of matches left out."""
    hits = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(group))).alias("item"))
    if drop:
        hits = hits.filter(~F.col("item").rlike(drop))
    return hits.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item").limit(most)


def log_sum(lines: DataFrame, pattern: str) -> DataFrame:
    """(total decimal(38,0)): sum of the numbers in every match of ``pattern`` in (line), its first group; 0 without any."""
    found = lines.select(F.explode(F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(1))).alias("x"))
    number = F.expr("try_cast(x as decimal(38,0))")
    return found.agg(F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("total"))


def diagnostic_counts(lines: DataFrame) -> DataFrame:
    """(warnings, errors): lines that begin so; summaries of generated warnings are left out."""
    return lines.agg(
        F.count_if(F.col("line").startswith("warning") & ~F.col("line").contains("generated")).alias("warnings"),
        F.count_if(F.col("line").startswith("error")).alias("errors"),
    )


def log_segments(lines: DataFrame, by: str, start: str = DIAGNOSTIC, reset: str | None = None) -> DataFrame:
    """The lines (by, n, line) of diagnostics: those that begin one, and every indented or blank line behind the first.

    reset: a pattern of lines that end a diagnostic, if wished. Windows run inside one log.
    """
    own = Window.partitionBy(by).orderBy("n")
    marked = lines.withColumn("begins", F.col("line").rlike(start))
    ends = F.col("line").rlike(reset) if reset else F.lit(False)
    state = F.last(F.when(ends, 0).when(F.col("begins"), 1), ignorenulls=True).over(own)
    follows = (F.col("line").startswith(" ") | (F.trim("line") == "")) & ~ends
    kept = marked.withColumn("open", state).filter(F.col("begins") | (follows & (F.col("open") == 1)))
    return kept.select(by, "n", "line")


def sections(lines: DataFrame, by: str) -> DataFrame:
    """(by, n, section, line): manifest lines with the [section] they stand in."""
    own = Window.partitionBy(by).orderBy("n")
    header = F.when(F.trim("line").rlike(r"^\[.*\]$"), F.regexp_extract(F.trim("line"), r"^\[+(.*?)\]+$", 1))
    return lines.withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(own)).filter("header is null").select(by, "n", "section", "line")


def features(lines: DataFrame, by: str) -> DataFrame:
    """(by, feature): names in the [features] section, the text before the first equals sign."""
    own = sections(lines, by).filter("section = 'features'").filter(F.col("line").contains("=") & ~F.trim("line").startswith("#"))
    return own.select(by, F.trim(F.split("line", "=", 2)[0]).alias("feature")).distinct()


def features_of_all(lines: DataFrame, by: str) -> DataFrame:
    """(feature): the union of the features of all manifests."""
    return features(lines, by).select("feature").distinct()


def byte_offsets(lines: DataFrame, by: str) -> DataFrame:
    """(by, n, line, offset): bytes before each line, line ends included."""
    own = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(own), F.lit(0)))


def item_lines(lines: DataFrame) -> DataFrame:
    """Lines that define an item, with its kind and name; a line scan that sees no edges."""
    pattern = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*(fn|struct|enum|trait|const|static|type|mod)\s+([A-Za-z_][A-Za-z0-9_]*)"
    return lines.filter(F.col("line").rlike(pattern)).withColumns({"kind": F.regexp_extract("line", pattern, 1), "name": F.regexp_extract("line", pattern, 2)})


def brace_depth(lines: DataFrame, by: str) -> DataFrame:
    """(by, n, line, depth): open braces before each line."""
    own = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda sign: F.length("line") - F.length(F.replace(F.col("line"), F.lit(sign)))
    return lines.withColumn("depth", F.coalesce(F.sum(count("{") - count("}")).over(own), F.lit(0)))


def missing_features(required: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supported, missing) of required (feature)."""
    return required.join(offered, "feature", "left_semi"), required.join(offered, "feature", "left_anti")


def first_unsupported(missing: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` of the missing features (feature), by name, for a report."""
    return missing.orderBy("feature").limit(n)


def first_in_order(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows in the order of ``key``, which tells rows apart; nulls last."""
    return rows.orderBy(F.col(key).asc_nulls_last()).limit(n)


def merged(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both maps, the second's value where both have the key."""
    both = first.select(key, value, F.lit(0).alias("order")).union(second.select(key, value, F.lit(1).alias("order")))
    return both.groupBy(key).agg(F.max_by(value, "order").alias(value))

