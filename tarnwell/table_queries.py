"""Registered queries of readers, writers, parsers, policies and walks on rows derived from the driver's tables, with their SQL.

What readers read is written first, below the shared folder, and stays there for the lazy result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import extraction, graph, lines, measurements, policies
from .plans.lineage import new_folder
from .queries import _EDGES, _REACHED, _SAFE, PART, _edges, _manifests, _part_items, _reached, _spread, _table, _traits
from .sources import files, parsers
from .streaming import watch


def _p() -> F.Column:
    return F.col("p_partkey")


def _text(spark: SparkSession, rows: DataFrame, name: str, *by: str) -> str:
    """Write (value) as text, one file for each value of ``by`` where given; the folder."""
    path = new_folder(spark, name)
    (rows.repartition(*by).write.partitionBy(*by) if by else rows.write).text(path)
    return path


BLOCK = 100_000  # numbers whose lines share a file


def _bodies(rows: DataFrame, by: str, order: str, line: F.Column) -> DataFrame:
    """(by, value): the lines of each group in ``order``, as one text; a group is a file."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(by).agg(joined.alias("value"))


def _blocks(rows: DataFrame, by: str, order: str, line: F.Column) -> DataFrame:
    """(by, block, value) as ``_bodies``, a file for each group and BLOCK of numbers, so that no file grows with the table."""
    rows = rows.withColumn("block", F.lpad(F.floor(F.col(order) / BLOCK).cast("string"), 12, "0"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(by, "block").agg(joined.alias("value"))


# readers and writers


def keep_lines(spark, sf_dir):
    k, hexes = F.col("o_orderkey"), F.concat(F.hex("o_orderkey"), F.lit(":"), F.hex("o_custkey"))
    line = F.when(k % 5 == 0, "# note").when(k % 5 == 1, F.concat(F.lit("  "), hexes)).when(k % 5 == 2, F.lower(hexes)).when(k % 5 == 3, F.concat(F.lit("zz:"), F.hex(k))).otherwise(F.hex(k))
    return files.read_keep(spark, _text(spark, _table(spark, sf_dir, "orders").select(line.alias("value")), "keep"))


def keep_files(spark, sf_dir):
    path = new_folder(spark, "keep-files")
    files.write_keep(_part_items(spark, sf_dir).select("scid", "lo"), path, per_partition=True)
    return spark.read.text(path, wholetext=True).select(F.col("scid").cast("string").alias("scid"), F.rtrim(F.regexp_replace("value", "\n", " ")).alias("body"))


def keep_appended(spark, sf_dir):
    path, keep = new_folder(spark, "keep-file"), _part_items(spark, sf_dir).select("scid", "lo")
    files.write_keep(keep.filter("scid < '4'"), path)
    files.write_keep(keep.filter("scid > '2'"), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


def compile_commands(spark, sf_dir):
    entry = F.to_json(F.struct(F.when(_p() % 3 == 0, F.concat(F.lit("/abs/"), _p())).otherwise(F.concat(F.lit("src/"), _p())).alias("file"), F.lit("/build").alias("directory"), F.col("p_type").alias("command")))
    rows = _blocks(_table(spark, sf_dir, "part"), "p_size", "p_partkey", entry)
    value = F.concat(F.lit("["), F.replace(F.col("value"), F.lit("\n"), F.lit(",\n")), F.lit("]"))
    path = _text(spark, rows.select(F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size"), "block", value.alias("value")), "commands", "size", "block")
    return files.read_compile_commands(spark, path)


def source_tree(spark, sf_dir):
    path = _text(spark, _bodies(_table(spark, sf_dir, "part"), "p_size", "p_partkey", F.col("p_name")), "sources", "p_size")
    out = files.read_sources(spark, path, "*.txt")
    return out.select(F.regexp_extract("path", r"p_size=(\d+)/", 1).cast("int").alias("p_size"), F.rtrim(F.regexp_replace("text", "\n", " ")).alias("text"))


def linked_symbols(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in "tTwWUd"]), (_p() % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select(F.concat(F.lpad(F.hex(_p()), 16, "0"), F.lit(" "), kind, F.lit(" "), "p_name").alias("value"))
    return files.read_symbols(spark, _text(spark, rows, "symbols"))


def timing_reports(spark, sf_dir):
    unit = F.to_json(F.struct(_p().cast("int").alias("i"), F.col("p_brand").alias("name"), F.lit("1.0").alias("version"), F.lit("todo").alias("mode"), (_p() * 0.5).alias("start"), F.col("p_size").cast("double").alias("duration")))
    rows = _blocks(_table(spark, sf_dir, "part"), "p_size", "p_partkey", unit)
    page = F.concat(F.lit("<html><script>const UNIT_DATA = ["), F.replace(F.col("value"), F.lit("\n"), F.lit(",\n")), F.lit("];</script></html>"))
    return files.read_timings(spark, _text(spark, rows.select("p_size", "block", page.alias("value")), "timings", "p_size", "block")).drop("file")


def key_values(spark, sf_dir):
    pair = F.concat(F.lit("k"), _p(), F.lit(" = "), "p_size", F.lit("\n# no pair\nk"), _p(), F.lit("=v="), _p(), F.lit("\nall = "), "p_size")
    return files.read_key_values(spark, _text(spark, _blocks(_table(spark, sf_dir, "part"), "p_size", "p_partkey", pair), "values", "p_size", "block"))


def named_dump(spark, sf_dir):
    path = new_folder(spark, "dump")
    files.write_named_dump(_table(spark, sf_dir, "part").select((_p() % 7).alias("scid"), _p().alias("lo"), F.col("p_name").alias("path")), path)
    return spark.read.text(path)


def error_log(spark, sf_dir):
    path, part = new_folder(spark, "errors"), _table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("log"), _p().alias("n"), F.concat(F.lit("error: "), "p_name").alias("line"))
    wrote = files.write_diagnostics(rows.filter("n % 10 = 0"), path) and not files.write_diagnostics(rows.filter("n < 0"), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n")).withColumn("wrote", F.lit(wrote))


def symbol_export(spark, sf_dir):
    path = new_folder(spark, "exports")
    files.write_symbols(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")), path)
    return spark.read.text(path)


def profile_file(spark, sf_dir):
    path = new_folder(spark, "profile")
    files.write_profile(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey long, n_name string").json(path)


def state_table(spark, sf_dir):
    path, part = new_folder(spark, "state"), _table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    files.write_state(part, path, "p_brand")
    files.write_state(part.filter("p_brand like '%1' and p_size > 25"), path, "p_brand")
    return files.read_state(spark, path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))


def result_store(spark, sf_dir):
    path = new_folder(spark, "results")
    for leg in (0, 1):
        files.append_results(_table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == leg).select(F.col("o_orderstatus").alias("project"), "o_orderkey"), path)
    return spark.read.parquet(path).groupBy("project").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def result_report(spark, sf_dir):
    path = new_folder(spark, "report")
    files.write_report(_table(spark, sf_dir, "nation"), path, "nations", ["n_nationkey", "n_name"])
    return spark.read.text(path)


def benchmark_table(spark, sf_dir):
    runs = _table(spark, sf_dir, "part").select(F.when(_p() == 1, "baseline").otherwise(F.concat(F.lit("r"), _p())).alias("name"), F.col("p_size").cast("double").alias("duration_secs"), (_p() % 4 != 3).alias("success"))
    return measurements.benchmark_summary(runs).withColumn("speedup", F.round("speedup", 6))


def incremental_misses(spark, sf_dir):
    now = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.md5("p_name").alias("hash"))
    return watch.recompute(now, now.filter("p_partkey % 3 > 0").withColumn("hash", F.when(_p() % 5 == 0, "old").otherwise(F.col("hash"))), ["p_partkey", "p_brand", "hash"]).select("p_partkey")


# extraction and parsing


def adjacency_lists(spark, sf_dir):
    return extraction.adjacency(_edges(spark, sf_dir)).select("src", F.array_join("targets", ",").alias("targets"), "n")


def cast_facts(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") == 1, "Unsize").when(F.col("l_linenumber") == 2, "ReifyFnPointer").when(F.col("l_linenumber") == 3, "ClosureFnPointer").otherwise("Misc")
    casts = _table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.when(F.col("l_quantity") > 5, F.col("l_partkey")).alias("target"), (F.col("l_suppkey") % 2 == 0).alias("is_fn"), F.when(F.col("l_quantity") > 10, F.col("l_suppkey")).alias("type_id"))
    dynamic, taken = extraction.cast_facts(casts)
    return dynamic.select(F.lit("type").alias("fact"), F.col("type_id").alias("id")).union(taken.select(F.lit("function"), "key"))


def asm_symbols(spark, sf_dir):
    return extraction.asm_symbols(_table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 4, "SymFn").otherwise("In").alias("kind"), F.when(F.col("l_quantity") > 40, F.col("l_partkey")).alias("target")))


def dynamic_traits(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Ref", "RawPtr", "Dynamic", "Adt")]), (_p() % 4 + 1).cast("int"))
    types = _table(spark, sf_dir, "part").select(_p().alias("type_id"), kind.alias("kind"), F.when(_p() % 3 != 0, _p() % 11).alias("principal"), F.when((_p() % 4 < 2) & (_p() % 8 != 0), F.floor(_p() / 2)).alias("inner"), "p_size")
    return extraction.dynamic_traits(types, types.filter("p_size > 45").select("type_id"))


_CODE = "pub fn p{0}() {{}}\nstruct S{0};\n  // fn no\nasync fn q{0}(x: u8) {{\n  fn inner{0}() {{ p{0}(); }}\n}}\nlet fn_x = 1;"


def _code(spark, sf_dir):
    head, *rest = _CODE.format("\0").split("\0")
    parts = [F.lit(head)]
    for piece in rest:
        parts += [_p().cast("string"), F.lit(piece)]
    return _spread(_table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.concat(*parts).alias("text"))


def line_items(spark, sf_dir):
    return parsers.parse_sources(_code(spark, sf_dir), "p_partkey", "lines").select(F.col("p_partkey").cast("long").alias("p_partkey"), "kind", "name", "line")


def brace_items(spark, sf_dir):
    return parsers.parse_sources(_code(spark, sf_dir), "p_partkey", "braces").select(F.col("p_partkey").cast("long").alias("p_partkey"), "kind", "name", "line", "within", "target")


def own_parser(spark, sf_dir):
    """A parser of one's own: a fact for every line that ends in a semicolon."""

    def statements(text):
        return [("statement", x.strip(), i, None, None) for i, x in enumerate(text.split("\n")) if x.endswith(";")]

    return parsers.parse_sources(_code(spark, sf_dir), "p_partkey", statements).groupBy("name").agg(F.count("*").alias("n"), F.max("line").alias("line"))


def brace_depths(spark, sf_dir):
    return lines.brace_depth(lines.lines_of(_code(spark, sf_dir), "p_partkey"), "p_partkey").select("p_partkey", "n", "depth")


def item_lines(spark, sf_dir):
    return lines.item_lines(lines.lines_of(_code(spark, sf_dir), "p_partkey")).select("p_partkey", "n", "kind", "name")


def workspace_sources(spark, sf_dir):
    """Sources of nested crates: each part's file lies in the crate of its size, in a folder of which a crate of its own may be."""
    size, part = F.col("p_size").cast("string"), _spread(_table(spark, sf_dir, "part"))
    sources = part.select(F.concat(F.lit("/w/c"), size, F.when(_p() % 2 == 0, "/inner"), F.lit("/src/f"), _p(), F.lit(".rs")).alias("path"), F.lit("fn x() {}").alias("text"))
    sources = sources.filter("path is not null").unionByName(part.filter("p_partkey % 2 = 1").select(F.concat(F.lit("/w/c"), size, F.lit("/src/f"), _p(), F.lit(".rs")).alias("path"), F.lit("fn x() {}").alias("text")))
    manifests = _table(spark, sf_dir, "part").select("p_size").distinct()
    text = lambda name: F.concat(F.lit("[package]\nname = \""), name, F.lit("\"\n"))
    own = manifests.select(F.concat(F.lit("/w/c"), size, F.lit("/Cargo.toml")).alias("path"), text(F.concat(F.lit("c-"), size)).alias("text"))
    inner = manifests.filter("p_size % 2 = 0").select(F.concat(F.lit("/w/c"), size, F.lit("/inner/Cargo.toml")).alias("path"), text(F.concat(F.lit("i-"), size)).alias("text"))
    return parsers.crate_sources(own.union(inner), sources).groupBy("crate").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def feature_union(spark, sf_dir):
    return lines.features_of_all(_manifests(spark, sf_dir), "p_partkey")


def unsupported_features(spark, sf_dir):
    name = lambda t, c: _table(spark, sf_dir, t).select(F.col(c).alias("feature")).distinct()
    return lines.first_unsupported(lines.missing_features(name("part", "p_type"), name("part", "p_type").filter("length(feature) % 2 = 0"))[1])


def first_types(spark, sf_dir):
    return lines.first_in_order(_table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_partkey").alias("path")), "p_type")


def scripts(spark, sf_dir):
    """Scripts with and without a #! line, a manifest and an edition."""
    manifest = F.when(_p() % 3 == 0, F.lit("[package]\nedition = \"2018\"\n")).when(_p() % 3 == 1, F.concat(F.lit("[package]\nname = \"p"), _p(), F.lit("\"\n"))).otherwise(F.lit("[dependencies]\n"))
    text = F.concat(F.when(_p() % 2 == 0, "#!/usr/bin/env run\n").otherwise(""), F.when(_p() % 5 > 0, F.concat(F.lit("---cargo\n"), manifest, F.lit("---\n"))).otherwise(""), F.lit("#include <a.h>\n  #include \"b"), _p(), F.lit(".h\"\nfn main() {}\n"))
    front = scalars.frontmatter(F.col("text"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", "text", front.alias("manifest"))
    return rows.select("p_partkey", F.array_join(scalars.includes(F.col("text")), ",").alias("includes"), "manifest", scalars.has_edition(F.col("manifest")).alias("has_edition"), scalars.with_edition(F.col("manifest")).alias("completed"))


def script_caches(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.script_cache_path(F.col("p_name"), "/tmp/").alias("path"))


def hex_numbers(spark, sf_dir):
    digits = F.when(_p() % 4 == 0, F.concat(F.lit(" "), F.lower(F.hex(_p())))).when(_p() % 4 == 1, F.concat(F.lit("ffffffff"), F.lpad(F.hex(_p()), 8, "0"))).when(_p() % 4 == 2, F.concat(F.hex(_p()), F.lit("xyz"))).otherwise(F.lit(""))
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.parse_hex(digits).cast("string").alias("number"))


# policies and walks


def packed_keys(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", graph.pack_key(F.col("p_size"), _p()).alias("key"))


def keep_rules(spark, sf_dir):
    """How many items go under no optional rule, under the longer checklist and under the proposed rules."""
    rules = dict(zip(policies.CHECKLIST + policies.PROPOSED, (41, 43, 47, 53, 59, 61, 67, 71, 73), strict=True))
    p = F.col("key") - PART
    items = _part_items(spark, sf_dir).withColumns({name: F.when(p % m == 0, None if name == "inlinable_across" else True).otherwise(False) for name, m in rules.items()})
    none = spark.createDataFrame([], "key long")
    out = None
    for name, keep in (("base", ()), ("checklist", policies.CHECKLIST), ("proposed", policies.PROPOSED)):
        gone = policies.deletable(items, none, none, _traits(spark), policies.Policy(keep=keep)).select(F.lit(name).alias("rules"), "key")
        out = gone if out is None else out.union(gone)
    return out.groupBy("rules").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"))


def threshold_modes(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 49).alias("stubs"), F.count("*").alias("total"))
    modes = ("auto", "never", "0", "3")
    return counts.select("l_suppkey", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), scalars.skip_decision(F.col("stubs"), F.col("total"), m).alias("decision")) for m in modes])).alias("x")).select("l_suppkey", "x.*")


_FLAGS = (("", False), ("-O1 -fcycle", False), ("-fcycle -fno-cycle -O", True), ("-fa -O0 -fb", True), ("", True))


def flag_levels(spark, sf_dir):
    """Levels and features that lists of flags resolve to, with presets of level 4."""
    rows = []
    for flags, local in _FLAGS:
        policy = policies.with_flags(policies.Policy(level=policies.default_level(local)), flags.split(), {4: ("wide", "deep")})
        rows.append((flags, local, policy.level, ",".join(sorted(policy.features))))
    return spark.createDataFrame(rows, "flags string, local_registry boolean, level int, features string")


def _parts_called(spark, sf_dir):
    """Parts call the part of twice their number, and odd ones that behind it."""
    n = _table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("most"))
    part = _table(spark, sf_dir, "part").crossJoin(F.broadcast(n))  # one row
    every = part.select((_p() + PART).alias("src"), (_p() * 2 + PART).alias("dst"), "most").union(part.filter(_p() % 2 == 1).select(_p() + PART, _p() * 2 + 1 + PART, "most"))
    return every.filter(F.col("dst") <= F.col("most") + PART).select("src", "dst")


def _taken(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select((F.col("l_partkey") + PART).alias("key"))


def whole_analysis(spark, sf_dir):
    mono = _table(spark, sf_dir, "lineitem").filter("l_quantity < 2").select((F.col("l_partkey") + PART).alias("key"))
    return graph.analyse(_part_items(spark, sf_dir), _parts_called(spark, sf_dir), _traits(spark), _taken(spark, sf_dir), mono).gone


def analysis_branches(spark, sf_dir):
    """What goes where a keep table stands in for the walk, and where there is no entry: nothing there."""
    items, calls, traits, taken = _part_items(spark, sf_dir), _parts_called(spark, sf_dir), _traits(spark), _taken(spark, sf_dir)
    none = spark.createDataFrame([], "key long")
    used = F.col("l_partkey")
    keep = _table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select((used % 7).cast("string").alias("scid"), used.cast("string").alias("lo")).distinct()
    kept = graph.analyse(items, calls, traits, taken, none, keep).gone.select(F.lit("keep table").alias("branch"), "key")
    return kept.union(graph.analyse(items.withColumn("is_entry", F.lit(False)), calls, traits, taken, none).gone.select(F.lit("no entry"), "key"))


def broken_invariant(spark, sf_dir):
    """Exported items that a walk from other seeds does not reach; from the analysis's own seeds there are none."""
    items = _part_items(spark, sf_dir)
    own = graph.reachable(_parts_called(spark, sf_dir), graph.collect_seeds(items, _traits(spark), _taken(spark, sf_dir)))
    left = graph.unreached_exports(items, _reached(spark, sf_dir)).select(F.lit("other").alias("walk"), "key")
    return left.union(graph.unreached_exports(items, own).select(F.lit("own"), "key"))


def cross_partition_marks(spark, sf_dir):
    p = F.col("key") - PART
    items = _part_items(spark, sf_dir).withColumns({"in_library": p % 7 != 0, "is_public": p % 50 == 1, "is_entry": F.when(p % 3 == 0, p % 29 == 0), "is_drop_impl": p % 97 == 0, "kind": F.when(p % 101 == 0, "Static").otherwise("Fn")})
    return graph.marks_by_partition(items, graph.reachable(_parts_called(spark, sf_dir), graph.cross_partition_seeds(items)))


def analysis_walk(spark, sf_dir):
    """What a walk over analysis records, one for each size, reaches."""
    p = _p().cast("string")
    line = F.concat(
        F.lit("[DEFINED_ITEMS]\n"), F.when(_p() == 7, "main").otherwise(F.concat(F.lit("p"), p)), F.lit("\nCALL_EDGES:\n"), F.when(_p() == 7, F.lit("main -> p14\n")).otherwise(F.concat(F.lit("p"), p, F.lit(" -> p"), _p() * 2, F.lit("\n"))),
        F.when(_p() % 500 == 3, F.concat(F.lit("NO_MANGLE\np"), p, F.lit("\n"))).otherwise(""), F.when(_p() % 500 == 9, F.concat(F.lit("TRAIT_IMPLS\np"), p, F.lit(" -> core::Drop\n"))).otherwise(F.concat(F.lit("TRAIT_IMPLS\np"), p, F.lit(" -> Clone\n"))),
    )
    texts = _blocks(_table(spark, sf_dir, "part"), "p_size", "p_partkey", line).select(F.concat(F.lit("c"), F.col("p_size")).alias("crate"), F.col("value").alias("text"))
    items, edges, seeds = files.analysis_graph(files.analysis_rows(texts))
    return items.join(graph.reachable(edges, seeds), "key", "left_semi").select("crate", "item")


def independent_parts(spark, sf_dir):
    nodes = _table(spark, sf_dir, "part").filter("p_partkey % 9 > 0").select((_p() + PART).alias("key"))
    return graph.independent_parts(_parts_called(spark, sf_dir), nodes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        keep_lines, keep_files, keep_appended, compile_commands, source_tree, linked_symbols, timing_reports, key_values, named_dump, error_log,
        symbol_export, profile_file, state_table, result_store, result_report, benchmark_table, incremental_misses, adjacency_lists, cast_facts,
        asm_symbols, dynamic_traits, line_items, brace_items, own_parser, brace_depths, item_lines, workspace_sources, feature_union,
        unsupported_features, first_types, scripts, script_caches, hex_numbers, packed_keys, keep_rules, threshold_modes, flag_levels,
        whole_analysis, analysis_branches, broken_invariant, cross_partition_marks, analysis_walk, independent_parts,
    )
}

_HEX = "lpad(lower(to_hex({0})), 16, '0')"
_CALLS = f"c AS (SELECT p_partkey + {PART} AS src, p_partkey * 2 + {PART} AS dst FROM part WHERE p_partkey * 2 <= (SELECT max(p_partkey) FROM part) UNION ALL SELECT p_partkey + {PART}, p_partkey * 2 + 1 + {PART} FROM part WHERE p_partkey % 2 = 1 AND p_partkey * 2 + 1 <= (SELECT max(p_partkey) FROM part))"
_OWN_SEEDS = f"SELECT p_partkey + {PART} AS key FROM part WHERE p_size > 40 OR p_partkey % 29 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 5 IN (1, 2)) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"
_OWN = f"own AS ({_OWN_SEEDS} UNION SELECT c.dst FROM own JOIN c ON c.src = own.key)"
_FNV = """lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS HUGEINT))),
  lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511628211) % CAST(18446744073709551616 AS HUGEINT)) AS UBIGINT))), 16, '0')"""


def _facts(*rows: str) -> str:
    return "SELECT p_partkey, x.* FROM (SELECT p_partkey, unnest([" + ", ".join(rows) + "]) AS x FROM part)"


def _rules(*modulo: int) -> str:
    return "".join(f" AND p_partkey % {m} <> 0" for m in modulo)


ORACLE_SQL: dict[str, str] = {
    "keep_lines": f"SELECT DISTINCT {_HEX.format('o_orderkey')} AS scid, {_HEX.format('o_custkey')} AS lo FROM orders WHERE o_orderkey % 5 IN (1, 2)",
    "keep_files": "SELECT CAST(p_partkey % 7 AS VARCHAR) AS scid, string_agg(p_partkey % 7 || ':' || p_partkey, ' ' ORDER BY CAST(p_partkey AS VARCHAR)) AS body FROM part GROUP BY 1",
    "keep_appended": "SELECT p_partkey % 7 || ':' || p_partkey AS value, CAST(CASE WHEN p_partkey % 7 = 3 THEN 2 ELSE 1 END AS BIGINT) AS n FROM part",
    "compile_commands": "SELECT CASE WHEN p_partkey % 3 = 0 THEN '/abs/' ELSE '/build/src/' END || p_partkey AS path, p_type AS command FROM part ORDER BY p_size, p_partkey LIMIT 500",
    "source_tree": "SELECT CAST(p_size AS INT) AS p_size, string_agg(p_name, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY 1",
    "linked_symbols": "SELECT DISTINCT p_name AS symbol FROM part WHERE p_partkey % 6 < 4",
    "timing_reports": "SELECT CAST(p_partkey AS INT) AS unit, p_brand AS name, '1.0' AS version, 'todo' AS mode, CAST(p_partkey * 0.5 AS DOUBLE) AS started, CAST(p_size AS DOUBLE) AS secs FROM part",
    "key_values": "SELECT 'k' || p_partkey AS key, 'v=' || p_partkey AS value FROM part UNION ALL SELECT 'all', CAST(arg_max(p_size, p_size || '/') AS VARCHAR) FROM part",
    "named_dump": "SELECT p_partkey % 7 || ':' || p_partkey || ' ' || p_name AS value FROM part",
    "error_log": "SELECT 'error: ' || p_name AS value, count(*) AS n, true AS wrote FROM part WHERE p_partkey % 10 = 0 GROUP BY 1",
    "symbol_export": "SELECT DISTINCT '    ' || p_brand || ';' AS value FROM part UNION ALL SELECT unnest(['{', '  global:', '  local: *;', '};'])",
    "profile_file": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "state_table": "SELECT p_brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part WHERE p_size > 25 OR NOT (p_brand LIKE '%1' AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 25)) GROUP BY 1",
    "result_store": "SELECT o_orderstatus AS project, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1",
    "result_report": "SELECT '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS value FROM nation UNION ALL SELECT unnest(['<html><head><title>nations</title></head><body><table><tr><th>n_nationkey</th><th>n_name</th></tr>', '</table></body></html>'])",
    "benchmark_table": "SELECT CASE WHEN p_partkey = 1 THEN 'baseline' ELSE 'r' || p_partkey END AS name, CAST(p_size AS DOUBLE) AS duration_secs, CASE WHEN p_partkey % 4 <> 3 THEN 'OK' ELSE 'FAIL' END AS status, CASE WHEN p_partkey % 4 <> 3 THEN round((SELECT p_size FROM part WHERE p_partkey = 1) / p_size, 6) END AS speedup FROM part",
    "incremental_misses": "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0",
    "adjacency_lists": f"WITH e AS ({_EDGES}) SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets, count(*) AS n FROM e GROUP BY 1",
    "cast_facts": "SELECT DISTINCT 'type' AS fact, l_suppkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 10 UNION ALL SELECT DISTINCT 'function', l_partkey FROM lineitem WHERE l_linenumber IN (2, 3) AND l_suppkey % 2 = 0 AND l_quantity > 5",
    "asm_symbols": "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_linenumber = 4 AND l_quantity > 40",
    "dynamic_traits": "WITH RECURSIVE m AS (SELECT p_partkey AS t FROM part WHERE p_size > 45 UNION SELECT t // 2 FROM m WHERE t % 4 < 2 AND t % 8 <> 0) SELECT DISTINCT t % 11 AS trait_key FROM m JOIN part ON p_partkey = t WHERE t % 4 = 2 AND t % 3 <> 0",
    "line_items": _facts(*(f"{{'kind': '{k}', 'name': '{n}' || p_partkey, 'line': {i}::BIGINT}}" for k, n, i in (("fn", "p", 0), ("struct", "S", 1), ("fn", "q", 3), ("fn", "inner", 4)))),
    "brace_items": _facts(*(f"{{'kind': '{k}', 'name': '{n}' || p_partkey, 'line': {i}::BIGINT, 'within': {w}, 'target': {t}}}" for k, n, i, w, t in (
        ("fn", "p", 0, "NULL::VARCHAR", "NULL::VARCHAR"), ("struct", "S", 1, "NULL::VARCHAR", "NULL::VARCHAR"), ("fn", "q", 3, "NULL::VARCHAR", "NULL::VARCHAR"),
        ("fn", "inner", 4, "'q' || p_partkey", "NULL::VARCHAR"), ("call", "p", 4, "'inner' || p_partkey", "'p' || p_partkey")))),
    "own_parser": "SELECT 'struct S' || p_partkey || ';' AS name, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS line FROM part UNION ALL SELECT 'let fn_x = 1;', count(*), 6 FROM part",
    "brace_depths": "SELECT p_partkey, CAST(i AS INT) AS n, CAST([0, 0, 0, 0, 1, 1, 0][i + 1] AS BIGINT) AS depth FROM part, range(7) r(i)",
    "item_lines": _facts(*(f"{{'n': {i}::INT, 'kind': '{k}', 'name': '{n}' || p_partkey}}" for k, n, i in (("fn", "p", 0), ("struct", "S", 1), ("fn", "q", 3), ("fn", "inner", 4)))),
    "workspace_sources": "SELECT crate, count(*) AS n, min(path) AS first FROM (SELECT CASE WHEN p_partkey % 2 = 0 AND p_size % 2 = 0 THEN 'i_' ELSE 'c_' END || p_size AS crate, '/w/c' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '/inner' ELSE '' END || '/src/f' || p_partkey || '.rs' AS path FROM part) GROUP BY 1",
    "feature_union": "SELECT DISTINCT 'f' || p_size AS feature FROM part",
    "unsupported_features": "SELECT DISTINCT p_type AS feature FROM part WHERE length(p_type) % 2 = 1 ORDER BY 1 LIMIT 5",
    "first_types": "SELECT p_type, max(p_partkey) AS path FROM part GROUP BY 1 ORDER BY 1 LIMIT 20",
    "scripts": """WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN CASE p_partkey % 3 WHEN 0 THEN '[package]' || chr(10) || 'edition = "2018"' || chr(10) WHEN 1 THEN '[package]' || chr(10) || 'name = "p' || p_partkey || '"' || chr(10) ELSE '[dependencies]' || chr(10) END END AS manifest FROM part)
SELECT p_partkey, 'a.h,b' || p_partkey || '.h' AS includes, manifest, manifest LIKE '%edition%' AS has_edition,
  CASE p_partkey % 3 WHEN 0 THEN manifest WHEN 1 THEN replace(manifest, '[package]' || chr(10), '[package]' || chr(10) || 'edition = "2021"' || chr(10)) ELSE '[package]' || chr(10) || 'edition = "2021"' || chr(10) || manifest END AS completed FROM m""",
    "script_caches": f"SELECT p_partkey, '/tmp/script-' || {_FNV.format('p_name')} AS path FROM part",
    "hex_numbers": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(CAST(4294967295 AS HUGEINT) * 4294967296 + p_partkey AS VARCHAR) END AS number FROM part",
    "packed_keys": "SELECT p_partkey, CAST(p_size AS BIGINT) * 4294967296 + p_partkey AS key FROM part",
    "keep_rules": " UNION ALL ".join(
        f"SELECT '{name}' AS rules, count(*) AS n, min(p_partkey) + {PART} AS least, max(p_partkey) + {PART} AS greatest FROM part WHERE ({_SAFE}{_rules(*modulo)}) OR (p_partkey % 2 = 0 AND p_size <= 5{_rules(*modulo)})"
        for name, modulo in (("base", ()), ("checklist", (41, 43, 47, 53)), ("proposed", (59, 61, 67, 71, 73)))
    ),
    "threshold_modes": "WITH n AS (SELECT l_suppkey, count(*) FILTER (l_quantity > 49) AS s FROM lineitem GROUP BY 1) SELECT l_suppkey, mode, CASE WHEN (mode = 'auto' AND s = 0) OR (mode = '3' AND s < 3) THEN 'skip' ELSE 'cut' END AS decision FROM n, (SELECT unnest(['auto', 'never', '0', '3']) AS mode)",
    "flag_levels": "SELECT * FROM (VALUES ('', false, 3, ''), ('-O1 -fcycle', false, 1, 'cycle'), ('-fcycle -fno-cycle -O', true, 4, 'deep,wide'), ('-fa -O0 -fb', true, 0, 'a,b'), ('', true, 1, '')) v(flags, local_registry, level, features)",
    "whole_analysis": f"WITH RECURSIVE {_CALLS}, {_OWN} SELECT p_partkey + {PART} AS key FROM part WHERE {_SAFE} AND p_partkey + {PART} NOT IN (SELECT key FROM own) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)",
    "analysis_branches": f"SELECT 'keep table' AS branch, p_partkey + {PART} AS key FROM part WHERE {_SAFE} AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "broken_invariant": f"{_REACHED} SELECT 'other' AS walk, p_partkey + {PART} AS key FROM part WHERE p_size > 40 AND p_partkey + {PART} NOT IN (SELECT key FROM r)",
    "cross_partition_marks": f"""WITH RECURSIVE {_CALLS}, m AS (SELECT p_partkey + {PART} AS key FROM part WHERE (p_partkey % 3 = 0 AND p_partkey % 29 = 0) OR (p_partkey % 50 = 1 AND p_partkey % 7 <> 0) OR p_partkey % 97 = 0 OR p_partkey % 101 = 0
UNION SELECT c.dst FROM m JOIN c ON c.src = m.key) SELECT CAST(p_partkey % 7 AS INT) AS krate, p_partkey + {PART} AS key, p_partkey % 50 = 1 AND p_partkey % 7 <> 0 AS is_seed FROM part JOIN m ON m.key = p_partkey + {PART}""",
    "analysis_walk": """WITH RECURSIVE m AS (SELECT p_partkey AS k FROM part WHERE p_partkey = 7 OR p_partkey % 500 IN (3, 9) UNION SELECT k * 2 FROM m WHERE k * 2 <= 1000000000)
SELECT 'c' || p_size AS crate, CASE WHEN p_partkey = 7 THEN 'main' ELSE 'p' || p_partkey END AS item FROM part JOIN m ON k = p_partkey""",
    "independent_parts": f"""WITH RECURSIVE {_CALLS}, e AS (SELECT src, dst FROM c WHERE (src - {PART}) % 9 > 0 AND (dst - {PART}) % 9 > 0), up AS (SELECT p_partkey + {PART} AS key, p_partkey + {PART} AS part FROM part WHERE p_partkey % 9 > 0
UNION SELECT up.key, e.src FROM up JOIN e ON e.dst = up.part) SELECT key, min(part) AS part FROM up GROUP BY 1""",
}
