"""Readers and writers of the text formats and tables of the build domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "rank int, name string, version string, downloads long, kind string, baseline_build_secs double, treated_build_secs double, speedup double, status string"
BENCH = "name string, duration_secs double, success boolean"
TIMING_UNIT = "i int, name string, version string, mode string, start double, duration double"
COMMANDS = "file string, directory string, command string"
MOST_COMMANDS, MOST_SOURCES = 500, 300  # caps that are the feature of these scans


def keep_pairs(lines: DataFrame) -> DataFrame:
    """(scid, lo) of the lines (value) of keep files: one pair of hex halves a line; comments, blank and malformed lines are skipped."""
    line = F.trim("value")
    halves = F.split(line, ":", 2)
    rows = lines.filter((line != "") & ~line.startswith("#")).select(F.try_element_at(halves, F.lit(1)).alias("scid"), F.try_element_at(halves, F.lit(2)).alias("lo"))
    return rows.filter("scid rlike '^[0-9a-fA-F]{1,16}$' and lo rlike '^[0-9a-fA-F]{1,16}$'").select(*[F.lpad(F.lower(c), 16, "0").alias(c) for c in ("scid", "lo")]).distinct()


def read_keep(spark: SparkSession, path: str) -> DataFrame:
    """(scid, lo) of a keep file, see keep_pairs."""
    return keep_pairs(spark.read.text(path))


def write_keep(keep: DataFrame, path: str, per_partition: bool = False) -> None:
    """Append pairs (scid, lo), sorted, to a keep file, or write one sorted file a scid."""
    if per_partition:
        keep.repartition("scid").sortWithinPartitions("scid", "lo").select("scid", F.concat_ws(":", "scid", "lo").alias("value")).write.partitionBy("scid").mode("overwrite").text(path)
    else:
        keep.select(F.concat_ws(":", "scid", "lo").alias("value")).sort("value").write.mode("append").text(path)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """(file, source_hash, item) of marked-item files: a SOURCE_HASH line, then an item a line."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    hash_ = F.regexp_extract(F.col("lines")[0], r"^SOURCE_HASH:\s*(\S+)", 1)
    return rows.select("file", hash_.alias("source_hash"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("item")).filter("trim(item) <> ''")


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines key=value; the later line of a file wins, and of several files the last by name."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line")).filter("line like '%=%'")
    parts = F.split("line", "=", 2)
    return rows.select(F.struct("file", "n").alias("at"), F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).groupBy("key").agg(F.max_by("value", "at").alias("value"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CORPUS)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH).json(path)


def read_compile_commands(spark: SparkSession, path: str, most: int = MOST_COMMANDS) -> DataFrame:
    """(path, command): the first ``most`` entries of the array, by file and place; relative files are joined to their directory."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.from_json("value", f"array<struct<{COMMANDS}>>").alias("entries"))
    rows = pages.select("page", F.posexplode("entries").alias("n", "x")).orderBy("page", "n").limit(most).select("x.*")
    return rows.select(F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file")).alias("path"), "command")


def read_sources(spark: SparkSession, path: str, pattern: str = "*.{c,cc,cpp,h,hpp}", most: int | None = MOST_SOURCES) -> DataFrame:
    """(path, text) of source files below ``path``."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows if most is None else rows.orderBy("path").limit(most)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of defined functions in a symbol listing (address, type, demangled name)."""
    pattern = r"^[0-9a-fA-F]+\s+[tTwW]\s+(.+)$"
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("symbol")).distinct()


def write_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """(file, unit, name, version, mode, started, secs) of timing reports: HTML pages that hold the units as JSON."""
    data = F.regexp_extract("value", r"(?s)(?:const|let|var)\s+UNIT_DATA\s*=\s*(\[.*?\])\s*;", 1)
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json(data, f"array<struct<{TIMING_UNIT}>>").alias("units"))
    return pages.select("file", F.explode("units").alias("u")).select("file", F.col("u.i").alias("unit"), "u.name", "u.version", "u.mode", F.col("u.start").alias("started"), F.col("u.duration").alias("secs"))


def read_bench_reports(spark: SparkSession, path: str) -> DataFrame:
    """(crate, runs, mean_secs, failed) over the bench.json files of a folder of crates."""
    rows = spark.read.schema(BENCH).option("recursiveFileLookup", "true").option("pathGlobFilter", "bench.json").json(path)
    crate = F.regexp_extract(F.input_file_name(), r"/([^/]+)/bench\.json$", 1)
    return aggregate_bench(rows.withColumn("crate", crate))


def aggregate_bench(rows: DataFrame) -> DataFrame:
    """(crate, runs, mean_secs, failed) over runs (crate, duration_secs, success)."""
    return rows.groupBy("crate").agg(F.count("*").alias("runs"), F.avg("duration_secs").alias("mean_secs"), F.count_if(~F.col("success")).alias("failed"))


def write_named_dump(items: DataFrame, path: str) -> None:
    """Lines `scid:lo name` of items, sorted in each file."""
    items.select(F.concat(F.concat_ws(":", "scid", "lo"), F.lit(" "), "path").alias("value")).sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_diagnostics(lines: DataFrame, path: str) -> bool:
    """Write diagnostics (log, n, line) as a log, if there are any; whether it did."""
    if lines.isEmpty():
        return False
    lines.sort("log", "n").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return True


def _between(head: list[str], rows: DataFrame, tail: list[str]) -> DataFrame:
    """(value): lines of head, then ``rows`` (value) in order, then lines of tail; dealt by ranges, so that part files follow each other."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(k, i, x) for k, lines in ((0, head), (2, tail)) for i, x in enumerate(lines)], "part int, n long, value string")
    every = ends.unionByName(rows.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), "value"))
    return every.sort("part", "n", "value").select("value")


def write_symbols(symbols: DataFrame, path: str) -> None:
    """A version script that exports ``symbols`` (symbol) and hides the rest: the part files in the order of their names."""
    rows = symbols.select(F.concat(F.lit("    "), "symbol", F.lit(";")).alias("value")).filter("value is not null").distinct()
    _between(["{", "  global:"], rows, ["  local: *;", "};"]).write.mode("overwrite").text(path)


def write_state(table: DataFrame, path: str, by: str) -> None:
    """Analysis state (marks, seeds, caches) as Parquet, a folder for each value of ``by``; only values in ``table`` are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to a table of results, a folder for each project."""
    results.write.mode("append").partitionBy("project").parquet(path)


def write_report(results: DataFrame, path: str, title: str, columns: list[str]) -> None:
    """An HTML table of ``results``, rows in their written order: the part files in the order of their names."""
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    head = "".join(f"<th>{c}</th>" for c in columns)
    top = f"<html><head><title>{title}</title></head><body><table><tr>{head}</tr>"
    _between([top], results.select(row.alias("value")), ["</table></body></html>"]).write.mode("overwrite").text(path)


ANALYSIS = ("DEFINED_ITEMS", "CALL_EDGES", "TRAIT_IMPLS", "STATICS", "NO_MANGLE")  # fixed values: sections of an analysis record


def analysis_rows(records: DataFrame, by: str = "crate") -> DataFrame:
    """(by, section, item, target) of the texts (by, text) of analysis records.

    A line that is a section's name, in brackets or with a colon too, begins it; others are its
    entries, ``item`` or ``item -> target``. Entries before the first section and in unknown ones
    are left out, blank lines and null texts too. The sections run inside one record; a ``by`` may
    have several.
    """
    # a part runs from a section's name to the next one: no window, so records of one ``by`` do not mix
    name = r" *\[?([A-Z_]+)\]?:?[\r\x{85}\x{2028}\x{2029}]? *"
    parts = records.select(by, F.explode(F.split("text", rf"(?dm)^(?={name}$)")).alias("part"))
    parts = parts.select(by, F.regexp_extract("part", rf"(?d)\A{name}(?:\n|\z)", 1).alias("section"), F.split("part", "\n").alias("lines")).filter(F.col("section").isin(*ANALYSIS))
    rows = parts.select(by, "section", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")).withColumn("line", F.trim("line")).filter("line <> ''")
    both = F.split("line", r"\s*->\s*", 2)
    return rows.select(by, "section", both[0].alias("item"), F.get(both, F.lit(1)).alias("target"))


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """(crate, section, item, target) of the .analysis files in a folder, see analysis_rows."""
    crate = F.regexp_extract(F.input_file_name(), r"([^/]+)\.analysis$", 1)
    texts = spark.read.option("pathGlobFilter", "*.analysis").text(path, wholetext=True).select(crate.alias("crate"), F.col("value").alias("text"))
    return analysis_rows(texts)


def analysis_graph(rows: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (key, crate, item), edges (src, dst) and seeds (key) of analysis records, for a walk over all of them.

    key: of an item's path. Seeds: items named main, statics, no_mangle items and the items of Drop impls.
    """
    defined = rows.filter("section = 'DEFINED_ITEMS'").select(key(F.col("item")).alias("key"), "crate", "item").distinct()
    edges = rows.filter("section = 'CALL_EDGES' and target is not null").select(key(F.col("item")).alias("src"), key(F.col("target")).alias("dst")).distinct()
    drop = (F.col("section") == "TRAIT_IMPLS") & F.col("target").rlike(r"(^|::)Drop$")
    seeds = rows.filter(drop | F.col("section").isin("STATICS", "NO_MANGLE") | ((F.col("section") == "DEFINED_ITEMS") & F.col("item").rlike("(^|::)main$")))
    return defined, edges, seeds.select(key(F.col("item")).alias("key")).distinct()
