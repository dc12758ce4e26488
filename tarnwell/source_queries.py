"""Registered queries of dumps, versioned tables, reports and flags, with their SQL; their inputs are written from the driver's tables and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extraction, policies
from .plans.lineage import new_folder
from .queries import _spread, _table
from .sources import files, mir, names, parsers, versions
from .streaming import watch


def _bodies(spark, sf_dir):
    """A function and a closure for each part, as text dumps: calls, a function as an argument, a cast, a closure, a call through a value."""
    p = F.col("p_partkey").cast("string")
    name = lambda k: (F.col("p_partkey") * k).cast("string")
    body = F.concat(
        F.lit("fn p"), p, F.lit("() -> () {\n    let mut _0: ();\n\n    bb0: {\n        _1 = p"), name(2), F.lit("::<u8, fn(i32) -> i32>(const 1_i32) -> [return: bb1, unwind continue];\n        _2 = apply(p"), name(3),
        F.lit(", move _1) -> [return: bb1, unwind continue];\n        _3 = p"), name(5), F.lit(" as fn() (PointerCoercion(ReifyFnPointer, Implicit));\n        _4 = {closure@src/p"), p,
        F.lit(".rs:1:1: 1:9} { x: copy _1 };\n        _5 = move _3(copy _4) -> [return: bb1, unwind continue];\n    }\n}\n\nfn p"), p, F.lit("::{closure#0}(_1: &{closure@src/p"), p,
        F.lit(".rs:1:1: 1:9}) -> () {\n    bb0: {\n        _0 = p"), name(7), F.lit("() -> [return: bb1, unwind continue];\n    }\n}\n"),
    )
    path = new_folder(spark, "mir")
    _table(spark, sf_dir, "part").select(body.alias("value")).write.text(path)
    return mir.read_mir(spark, path)


def mir_edges(spark, sf_dir):
    """Edges between functions that have bodies, from dump text, by name."""
    bodies = _bodies(spark, sf_dir)
    edges, functions = extraction.body_edges(mir.statements(bodies)), mir.functions(bodies)
    at = lambda end, name: functions.select(F.col("key").alias(end), F.col("name").alias(name))
    return edges.join(at("src", "caller"), "src").join(at("dst", "callee"), "dst").select("caller", "callee")


def mir_casts(spark, sf_dir):
    """How many functions of dumps have their address taken, among those that have bodies."""
    bodies = _bodies(spark, sf_dir)
    taken = extraction.cast_facts(mir.casts(bodies))[1]
    return mir.functions(bodies).join(taken, "key", "left_semi").select("name")


def state_versions(spark, sf_dir):
    """What a second version, of the large parts' brands alone, changed in a versioned table of parts."""
    path = new_folder(spark, "state")
    part = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("mark"))
    versions.write_version(part, path, "p_brand")
    newer = part.filter("p_brand like '%1'").filter("mark > 10").withColumn("mark", F.when(F.col("p_partkey") % 2 == 0, F.col("mark") + 100).otherwise(F.col("mark")))
    versions.write_version(newer, path, "p_brand", after=1)
    return versions.changes(spark, path, 1, 2)


def state_latest(spark, sf_dir):
    """The latest of three versions, after the third was written and old folders were put together."""
    path = new_folder(spark, "state")
    orders = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    versions.write_version(orders, path, "o_orderpriority")
    versions.write_version(orders.filter("o_orderpriority like '1%' and o_orderstatus = 'F'"), path, "o_orderpriority")
    versions.write_version(orders.filter("o_orderpriority = '2-HIGH'").withColumn("o_orderstatus", F.lit("X")), path, "o_orderpriority")
    versions.compact(spark, path)
    return versions.read_version(spark, path)


def bench_reports(spark, sf_dir):
    """bench.json files, one for each customer's orders, read back and aggregated."""
    path = new_folder(spark, "bench")
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("crate"), F.concat(F.lit("run"), "o_orderkey").alias("name"), F.floor("o_totalprice").alias("duration_secs"), (F.col("o_orderstatus") != "F").alias("success"))
    rows.repartition("crate").write.partitionBy("crate").json(path)
    read = spark.read.schema(files.BENCH).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    crate = F.regexp_extract(F.input_file_name(), r"/crate=([^/]+)/", 1)
    return files.aggregate_bench(read.select("*", crate.alias("crate")))


def flag_table(spark, sf_dir):
    """Levels and features that the flags of each part's build resolve to, flags being rows."""
    p = F.col("p_partkey")
    flags = F.concat_ws(" ", F.when(p % 3 == 0, "-O2"), F.concat(F.lit("-f"), "p_brand"), F.when(p % 4 == 0, "-O"), F.when(p % 5 == 0, F.concat(F.lit("-fno-"), "p_brand")), F.when(p % 7 == 0, "-fwide"))
    return policies.resolved_flags(_table(spark, sf_dir, "part").select("p_partkey", flags.alias("flags"), (p % 2 == 0).alias("local_registry")), "p_partkey", "flags", "local_registry", {4: ("wide", "deep")})


def quiet_changes(spark, sf_dir):
    """Runs of a user's events closer than half an hour whose last event's type is not that of the run before."""
    out = watch.quiet_changes(_table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "30 minutes")
    return out.select(F.col("user_id").cast("string").alias("user_id"), F.unix_micros("at").alias("at_us"), "hash")


def watch_stream(spark, sf_dir):
    """The same from a stream with state, over files of events; a last event of no user closes all runs."""
    path, kind = new_folder(spark, "events"), "user_id long, ts timestamp, event_type string"
    events = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{path}/in/a")
    end = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    end.select(F.lit(None).cast("long").alias("user_id"), "ts", F.lit("end").alias("event_type")).withColumn("user_id", F.lit(-1).cast("long")).write.parquet(f"{path}/in/b")
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        out = watch.watch(stream, "user_id", "ts", "event_type", 30 * 60 * 1000, "1 day")
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{path}/out").select(F.col("key").alias("user_id"), F.unix_micros("at").alias("at_us"), "hash")


def _named_sources(spark, sf_dir):
    """A file for each part in the crate of its brand, all with the same names: a type, its trait, a helper, and calls of the type of the next part."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.lower(F.translate("p_brand", "#", "_")).alias("crate"))
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("crate").alias("there"), F.concat(F.lit("m"), "p_partkey").alias("file"))
    rows = _spread(part.join(following, "p_partkey", "left"))
    there, file = F.coalesce("there", "crate"), F.coalesce("file", F.concat(F.lit("m"), "p_partkey"))
    odd = F.col("p_partkey") % 2 == 1
    text = F.concat(
        F.when(odd, F.concat(F.lit("use "), there, F.lit("::"), file, F.lit("::Item as Other;\n"))).otherwise(F.concat(F.lit("use "), there, F.lit("::{"), file, F.lit(" as next};\n"))),
        F.lit(
            "use crate::shared::*;\npub struct Item { n: i64 }\nimpl Item { pub fn new() -> Self { Item { n: 1 } } fn run(&self) { self.draw(); } }\n"
            "impl Draw for Item { fn draw(&self) { helper(); } }\nfn helper() { }\npub fn go(x: &Item) { let y = "
        ),
        F.when(odd, "Other").otherwise("next::Item"), F.lit("::new(); y.run(); x.draw(); x.twice(); }\n"),
    )
    sources = rows.select("crate", F.concat(F.lit("/w/"), "crate", F.lit("/src/m"), "p_partkey", F.lit(".rs")).alias("path"), text.alias("text"))
    shared = F.lit("pub trait Draw { fn draw(&self); fn twice(&self) { } }\n")
    return sources.union(part.select("crate").distinct().select("crate", F.concat(F.lit("/w/"), "crate", F.lit("/src/shared.rs")), shared))


def named_calls(spark, sf_dir):
    """Calls between functions of many equal names, each resolved to one, by owner and name."""
    functions, calls = names.resolved_calls(names.source_names(_named_sources(spark, sf_dir)))
    at = lambda end, to: functions.select(F.col("id").alias(end), F.concat(F.coalesce("owner", "module"), F.lit("."), "name").alias(to))
    return calls.join(at("src", "caller"), "src").join(at("dst", "callee"), "dst").select("caller", "callee", "how")


def edges_saved(spark, sf_dir):
    """Edges by names alone, in a crate, and edges when names are resolved, over the same sources."""
    sources = _named_sources(spark, sf_dir)
    functions, resolved = names.resolved_calls(names.source_names(sources))
    crate = functions.select(F.col("id").alias("src"), "crate")
    resolved = resolved.join(crate, "src").groupBy("crate").agg(F.count("*").alias("resolved"))
    # calls by name are counted, not listed: callers of a name times functions of that name
    facts = parsers.parse_sources(sources.select(F.concat_ws(" ", "crate", "path").alias("file"), "text"), "file", "braces")
    facts = facts.withColumn("crate", F.split("file", " ")[0]).withColumn("called", F.coalesce("target", "name"))
    defined = facts.filter("kind = 'fn'").groupBy("crate", "name").agg(F.count("*").alias("n_defined"))
    called = facts.filter("kind = 'call'").select("crate", "file", "within", F.col("target").alias("name")).distinct().groupBy("crate", "name").agg(F.count("*").alias("n_calls"))
    by_name = called.join(defined, ["crate", "name"]).groupBy("crate").agg(F.sum(F.col("n_calls") * F.col("n_defined")).alias("by_name"))
    return by_name.join(resolved, "crate")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (mir_edges, mir_casts, state_versions, state_latest, bench_reports, flag_table, quiet_changes, watch_stream, named_calls, edges_saved)}

_QUIET = """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT user_id, k, max({'t': ts, 'h': event_type}) AS x FROM s GROUP BY 1, 2), q AS (SELECT user_id, x.t AS t, x.h AS hash, lag(x.h) OVER (PARTITION BY user_id ORDER BY x.t) AS had FROM r)
SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(t) AS at_us, hash FROM q WHERE had IS NULL OR had <> hash"""

# the parts with their file and the file that each calls
_FILES = """p AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '_')) AS crate FROM part),
f AS (SELECT a.crate, a.crate || '::m' || a.k AS here, CASE WHEN b.k IS NULL THEN a.crate || '::m' || a.k ELSE b.crate || '::m' || b.k END AS there FROM p a LEFT JOIN p b ON b.k = a.k + 1)"""

ORACLE_SQL: dict[str, str] = {
    "named_calls": f"""WITH {_FILES} SELECT here || '::Item.run' AS caller, here || '::Item.draw' AS callee, 'receiver' AS how FROM f
UNION ALL SELECT here || '::Item.draw', here || '.helper', 'path' FROM f UNION ALL SELECT here || '.go', there || '::Item.new', 'path' FROM f
UNION ALL SELECT here || '.go', there || '::Item.run', 'receiver' FROM f UNION ALL SELECT here || '.go', here || '::Item.draw', 'receiver' FROM f
UNION ALL SELECT here || '.go', crate || '::shared::Draw.twice', 'trait' FROM f""",
    "edges_saved": f"""WITH {_FILES} SELECT crate, CAST(count(*) * (3 * count(*) + 2 * (count(*) + 1) + 1) AS BIGINT) AS by_name, CAST(6 * count(*) AS BIGINT) AS resolved FROM f GROUP BY crate""",
    "quiet_changes": _QUIET,
    "watch_stream": _QUIET,
    "mir_edges": """WITH k AS (SELECT p_partkey AS p FROM part), e AS (SELECT p, unnest([p * 2, p * 3, p * 5]) AS q FROM k)
SELECT DISTINCT 'p' || p AS caller, 'p' || q AS callee FROM e WHERE q IN (SELECT p FROM k) UNION ALL SELECT 'p' || p, 'p' || p || '::{closure#0}' FROM k
UNION ALL SELECT 'p' || p || '::{closure#0}', 'p' || p * 7 FROM k WHERE p * 7 IN (SELECT p FROM k)""",
    "mir_casts": "SELECT 'p' || p_partkey AS name FROM part WHERE p_partkey % 5 = 0",
    "state_versions": """WITH a AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS mark FROM part WHERE p_brand LIKE '%1' AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 10)),
b AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN mark + 100 ELSE mark END AS mark FROM a WHERE mark > 10)
SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "state_latest": "SELECT o_orderpriority, o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderstatus <> 'F')",
    "bench_reports": "SELECT CAST(o_custkey % 40 AS VARCHAR) AS crate, count(*) AS runs, avg(floor(o_totalprice)) AS mean_secs, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1",
    "flag_table": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 4 WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END AS level,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [p_brand] END, CASE WHEN p_partkey % 4 = 0 THEN ['deep', 'wide'] ELSE [] END, CASE WHEN p_partkey % 7 = 0 THEN ['wide'] ELSE [] END))), ',') AS features FROM part""",
}
