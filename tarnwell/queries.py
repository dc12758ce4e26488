"""Registered queries of the library's own operators on the driver's tables, with their SQL.

The tables hold no call graph, so graph queries run on one derived from foreign keys: nations,
customers, orders, suppliers and parts as nodes (keys offset by kind), chosen keys as edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import graph, lines, measurements
from .streaming import watch

CUSTOMER, ORDER, SUPPLIER, PART = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000, 4_000_000_000_000
SEEDS = (0, 3, 7, 12)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(keys: DataFrame) -> DataFrame:
    """``keys``, rows with p_partkey, over all tasks: texts made of them take long to parse, however few files their table has."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, line, supplier = (_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    line = line.filter("l_quantity > 45")
    pair = lambda df, a, b: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"))
    c = F.col
    parts = (
        pair(orders.filter("o_orderpriority = '1-URGENT'"), c("o_custkey") + CUSTOMER, c("o_orderkey") + ORDER),
        pair(line, c("l_orderkey") + ORDER, c("l_suppkey") + SUPPLIER),
        pair(line, c("l_orderkey") + ORDER, c("l_partkey") + PART),
        pair(supplier.filter("s_acctbal < 2000"), c("s_suppkey") + SUPPLIER, c("s_nationkey")),
        pair(customer.filter("c_custkey % 5 = 0"), c("c_nationkey"), c("c_custkey") + CUSTOMER),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(k,) for k in SEEDS], "key long")
    return graph.reachable(_edges(spark, sf_dir), seeds)


def _kind(key: str = "key") -> F.Column:
    return F.floor(F.col(key) / CUSTOMER).cast("int")


_EDGES = f"""
SELECT o_custkey + {CUSTOMER} AS src, o_orderkey + {ORDER} AS dst FROM orders WHERE o_orderpriority = '1-URGENT'
UNION SELECT l_orderkey + {ORDER}, l_suppkey + {SUPPLIER} FROM lineitem WHERE l_quantity > 45
UNION SELECT l_orderkey + {ORDER}, l_partkey + {PART} FROM lineitem WHERE l_quantity > 45
UNION SELECT s_suppkey + {SUPPLIER}, s_nationkey FROM supplier WHERE s_acctbal < 2000
UNION SELECT c_nationkey, c_custkey + {CUSTOMER} FROM customer WHERE c_custkey % 5 = 0
"""
_REACHED = f"""
WITH RECURSIVE e AS ({_EDGES}), r AS (
  SELECT CAST(unnest([{", ".join(map(str, SEEDS))}]) AS BIGINT) AS key UNION SELECT e.dst FROM r JOIN e ON e.src = r.key
)
"""


def reach_bfs(spark, sf_dir):
    return _reached(spark, sf_dir)


def reach_by_kind(spark, sf_dir):
    return _reached(spark, sf_dir).groupBy(_kind().alias("kind")).agg(F.count("*").alias("n"))


def _part_items(spark, sf_dir):
    """Parts as items: attributes of the safety rules derived from their columns."""
    p = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        (p + PART).alias("key"), F.lit(True).alias("is_local"), (F.col("p_size") > 5).alias("is_fn_like"),
        F.when(p % 3 == 0, "AssocFn").when(p % 3 == 1, "Fn").otherwise("Static").alias("kind"),
        *[(p % m == 0).alias(n) for n, m in (("no_mangle", 11), ("used_linker", 13), ("has_symbol_name", 17), ("has_linkage", 19), ("is_drop_impl", 23), ("is_entry", 29), ("requires_mono", 31), ("is_async", 37))],
        (p % 5).alias("trait_key"), (p % 2 == 0).alias("trait_dyn_compatible"),
        (p % 7).cast("string").alias("scid"), p.cast("string").alias("lo"), F.col("p_brand").alias("brand"), (p % 7).cast("int").alias("krate"),
        (F.col("p_size") > 40).alias("in_reachable_set"), (p % 2 == 1).alias("is_public"),
    )


_SAFE = """p_partkey % 3 <> 2 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0
AND p_partkey % 23 <> 0 AND p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 37 <> 0
AND NOT (p_partkey % 5 IN (1, 2) AND p_partkey % 2 = 0) AND p_size > 5"""


def _traits(spark):
    return spark.createDataFrame([(1,), (2,)], "trait_key long")


def eliminable_set(spark, sf_dir):
    mono = _table(spark, sf_dir, "lineitem").filter("l_quantity < 2").select((F.col("l_partkey") + PART).alias("key"))
    return graph.eliminable(_part_items(spark, sf_dir), _reached(spark, sf_dir), mono, _traits(spark))


def seeded_elimination(spark, sf_dir):
    keep = _table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select((F.col("l_partkey") % 7).cast("string").alias("scid"), F.col("l_partkey").cast("string").alias("lo"))
    return graph.seeded_elimination(_part_items(spark, sf_dir), keep, _traits(spark))


def seed_reduction_by_partition(spark, sf_dir):
    return graph.reduction_by(_part_items(spark, sf_dir), _reached(spark, sf_dir), "brand")


def gap_ratio(spark, sf_dir):
    marked = _part_items(spark, sf_dir).join(_reached(spark, sf_dir).withColumn("hit", F.lit(1)), "key", "left")
    return marked.groupBy("brand").agg(measurements.gap(F.count("*"), F.count("hit")).alias("gap"))


def codegen_units(spark, sf_dir):
    p = F.col("p_partkey")
    units = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("cgu"), (p + PART).alias("item"), (p % 4 > 0).alias("is_fn"), (p % 6 > 0).alias("is_local"), (p % 5 == 0).alias("inlined"), F.col("p_size").cast("long").alias("size"))
    gone = _table(spark, sf_dir, "part").filter("p_size > 20").select((p + PART).alias("key"))
    return graph.codegen_units(units, gone)


def skip_decision(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 49.5).alias("stubs"), F.count("*").alias("total"))
    return counts.select("l_suppkey", "stubs", "total", scalars.skip_decision(F.col("stubs"), F.col("total")).alias("decision"))


def _dag(spark, sf_dir):
    """Regions depend on their nations, nations on customers, customers on orders."""
    nation, customer, orders = (_table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    c = F.col
    deps = nation.select((c("n_regionkey") - 100).cast("long").alias("src"), c("n_nationkey").cast("long").alias("dst"))
    deps = deps.union(customer.select(c("c_nationkey").cast("long"), c("c_custkey") + CUSTOMER)).union(orders.select(c("o_custkey") + CUSTOMER, c("o_orderkey") + ORDER))
    weights = _table(spark, sf_dir, "region").select((c("r_regionkey") - 100).cast("long").alias("key"), F.lit(1.0).alias("weight"))
    weights = weights.union(nation.select(c("n_nationkey").cast("long"), (1.0 + c("n_nationkey") % 3).cast("double"))).union(customer.select(c("c_custkey") + CUSTOMER, c("c_acctbal")))
    return weights.union(orders.select(c("o_orderkey") + ORDER, c("o_totalprice"))), deps


def topo_levels(spark, sf_dir):
    weights, deps = _dag(spark, sf_dir)
    return graph.topological_levels(weights, deps).groupBy("level").agg(F.count("*").alias("n"), F.min("key").alias("least"))


def critical_path(spark, sf_dir):
    weights, deps = _dag(spark, sf_dir)
    return graph.critical_path(weights, deps).select("key", F.round("cp", 2).alias("cp"))


def _pairs(spark, sf_dir):
    """Parts measured in two legs: lines of even and of odd orders."""
    runs = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.when(F.col("l_orderkey") % 2 == 0, "baseline").otherwise("treated").alias("leg"), F.col("l_quantity").alias("secs"))
    return measurements.pair_legs(runs, "unit", "leg", "secs").withColumn("kind", F.when(F.col("unit") % 4 == 0, "bin").otherwise("lib"))


_PAIRS = """
SELECT unit, baseline, treated, baseline / treated AS speedup, baseline - treated AS saved, CASE WHEN unit % 4 = 0 THEN 'bin' ELSE 'lib' END AS kind
FROM (SELECT l_partkey AS unit, avg(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity END) AS baseline, avg(CASE WHEN l_orderkey % 2 <> 0 THEN l_quantity END) AS treated FROM lineitem GROUP BY 1)
WHERE baseline IS NOT NULL AND treated IS NOT NULL AND treated <> 0
"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def paired_speedup(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir), "baseline", "treated", "speedup", "saved")


def speedup_percentiles(spark, sf_dir):
    return _rounded(measurements.percentiles(_pairs(spark, sf_dir), "kind"), "mean", "p10", "median", "p90")


def speedup_share(spark, sf_dir):
    return _rounded(measurements.shares(_pairs(spark, sf_dir), "kind"), "ge_1_0", "ge_1_5", "ge_2_0")


def speedup_histogram(spark, sf_dir):
    return _rounded(measurements.histogram(_pairs(spark, sf_dir)), "percent")


def topk_ratio(spark, sf_dir):
    return _rounded(measurements.top(_pairs(spark, sf_dir), "speedup", "unit").select("unit", "speedup"), "speedup")


def status_matrix(spark, sf_dir):
    return measurements.status_matrix(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


def unit_delta(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    total = lambda flag: line.filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return measurements.unit_deltas(total("A"), total("R"), "l_partkey", "q")


def kpi_throughput(spark, sf_dir):
    per = _table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") + 1).alias("compile_s"), (F.max("value") + 1).alias("check_s"))
    return per.select("event_type", measurements.throughput(F.col("compile_s"), F.col("check_s"), F.lit(0.5), F.lit(1.0), 8).alias("k")).select("event_type", "k.samples", "k.checks", F.round("k.s_per_pass", 6).alias("s_per_pass"), "k.cluster_samples")


def failure_rate(spark, sf_dir):
    return _rounded(measurements.over_failure_rate(_table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("success")), 0.4), "failed_share")


def phase_profile(spark, sf_dir):
    out = measurements.phase_profile(_table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms")))
    return _rounded(out, "total_ms")


def pattern_frequency(spark, sf_dir):
    return lines.pattern_frequency(_table(spark, sf_dir, "documents"), "[A-Z][a-z]+ing", 0, 10)


def log_segments(spark, sf_dir):
    rows = lines.lines_of(_table(spark, sf_dir, "documents"), "doc_id")
    return lines.log_segments(rows, "doc_id", "^(The|In|Und|La) ").groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.min("n").alias("first_line"))


def _manifests(spark, sf_dir):
    """(p_partkey, n, line): the lines of a manifest for each part."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("[package]\nname = "), "p_name", F.lit("\n\n[features]\nf"), size, F.lit(" = []\n# g = 1\n[dependencies]\nx = "), size)
    return lines.lines_of(_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")


def section_carry(spark, sf_dir):
    return lines.sections(_manifests(spark, sf_dir), "p_partkey")


def byte_offsets(spark, sf_dir):
    rows = lines.byte_offsets(lines.lines_of(_table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("offset").alias("last_offset"), F.count("*").alias("n_lines"))


def fnv1a_hash(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.fnv1a_hex("p_name").alias("hash"))


def names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.crate_name(F.concat_ws("-", "p_brand", "p_type")).alias("crate"),
        scalars.without_version(F.concat_ws("-", "p_brand", F.when(F.col("p_size") % 3 == 0, "2d-core").when(F.col("p_size") % 3 == 1, F.concat("p_size", F.lit(".1"))).otherwise("core"))).alias("unit"),
        scalars.plan_key(F.col("p_name")).alias("plan"),
        scalars.hex16(F.col("p_partkey")).alias("key"),
    )


def cache_hit_miss(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    key = scalars.cache_key(F.col("p_brand"), F.col("p_type"), F.col("p_size"))
    cache = part.filter("p_partkey % 3 = 0").select(key.alias("key"))
    return watch.cache_lookup(part.select("p_partkey", key.alias("key")), cache).groupBy("hit").agg(F.count("*").alias("n"), F.min("key").alias("least_key"))


def staleness_gate(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    now = orders.select("o_orderkey", F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("hash"))
    marks = orders.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.md5(F.concat_ws("|", F.when(F.col("o_orderkey") % 10 == 1, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority")).alias("hash"))
    return watch.stale(now, marks, "o_orderkey", "hash")


def session_debounce(spark, sf_dir):
    out = watch.debounce(_table(spark, sf_dir, "events"), "user_id", gap="30 minutes")
    return out.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        reach_by_kind, reach_bfs, eliminable_set, seeded_elimination, seed_reduction_by_partition, gap_ratio, codegen_units, skip_decision,
        topo_levels, critical_path, paired_speedup, speedup_percentiles, speedup_share, speedup_histogram, topk_ratio, status_matrix,
        unit_delta, kpi_throughput, failure_rate, phase_profile, pattern_frequency, log_segments, section_carry, byte_offsets, fnv1a_hash,
        names, cache_hit_miss, staleness_gate, session_debounce,
    )
}

_SHA = "sha256(length(p_brand) || ':' || p_brand || '|' || length(p_type) || ':' || p_type || '|' || length(CAST(p_size AS VARCHAR)) || ':' || p_size)"
_BUCKET = " + ".join(f"CASE WHEN speedup >= {e} THEN 1 ELSE 0 END" for e in measurements.EDGES)

ORACLE_SQL: dict[str, str] = {
    "reach_bfs": f"{_REACHED} SELECT key FROM r",
    "reach_by_kind": f"{_REACHED} SELECT CAST(key // {CUSTOMER} AS INT) AS kind, count(*) AS n FROM r GROUP BY 1",
    "eliminable_set": f"{_REACHED} SELECT p_partkey + {PART} AS key FROM part WHERE {_SAFE} AND p_partkey + {PART} NOT IN (SELECT key FROM r) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)",
    "seeded_elimination": f"SELECT p_partkey + {PART} AS key FROM part WHERE {_SAFE} AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "seed_reduction_by_partition": f"{_REACHED} SELECT p_brand AS brand, count(*) AS n_items, count(r.key) AS n_marked, count(*) - count(r.key) AS removed, 100.0 * (count(*) - count(r.key)) / count(*) AS percent_removed, count(*) = count(r.key) AS skip FROM part LEFT JOIN r ON r.key = p_partkey + {PART} GROUP BY 1",
    "gap_ratio": f"{_REACHED} SELECT p_brand AS brand, (count(*) - count(r.key)) / count(*) AS gap FROM part LEFT JOIN r ON r.key = p_partkey + {PART} GROUP BY 1",
    "codegen_units": "SELECT p_brand AS cgu, count(*) AS n_items, CAST(sum(p_size) AS BIGINT) AS size FROM part WHERE NOT (p_partkey % 4 > 0 AND p_partkey % 6 > 0 AND p_partkey % 5 <> 0 AND p_size > 20) GROUP BY 1",
    "skip_decision": "SELECT l_suppkey, stubs, total, CASE WHEN stubs = 0 THEN 'skip' WHEN stubs < 5 AND stubs < 0.02 * total THEN 'skip' ELSE 'cut' END AS decision FROM (SELECT l_suppkey, count(*) FILTER (l_quantity > 49.5) AS stubs, count(*) AS total FROM lineitem GROUP BY 1)",
    "topo_levels": f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders),
cl AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey IN (SELECT c FROM o) THEN 1 ELSE 0 END AS l FROM customer),
nl AS (SELECT n_nationkey AS k, n_regionkey AS r, coalesce((SELECT max(l) + 1 FROM cl WHERE n = n_nationkey), 0) AS l FROM nation),
rl AS (SELECT r_regionkey AS k, coalesce((SELECT max(l) + 1 FROM nl WHERE r = r_regionkey), 0) AS l FROM region),
every AS (SELECT k + {ORDER} AS key, 0 AS level FROM o UNION ALL SELECT k + {CUSTOMER}, l FROM cl UNION ALL SELECT k, l FROM nl UNION ALL SELECT k - 100, l FROM rl)
SELECT CAST(level AS INT) AS level, count(*) AS n, min(key) AS least FROM every GROUP BY 1""",
    "critical_path": f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal + coalesce((SELECT greatest(max(o_totalprice), 0) FROM orders WHERE o_custkey = c_custkey), 0) AS cp FROM customer),
n AS (SELECT n_nationkey AS k, n_regionkey AS r, 1.0 + n_nationkey % 3 + coalesce((SELECT max(cp) FROM c WHERE c.n = n_nationkey), 0) AS cp FROM nation),
r AS (SELECT r_regionkey - 100 AS k, 1.0 + coalesce((SELECT max(cp) FROM n WHERE n.r = r_regionkey), 0) AS cp FROM region)
SELECT CAST(k AS BIGINT) AS key, round(cp, 2) AS cp FROM n UNION ALL SELECT CAST(k AS BIGINT), round(cp, 2) FROM r
UNION ALL SELECT k + {CUSTOMER}, round(cp, 2) FROM c UNION ALL SELECT o_orderkey + {ORDER}, round(o_totalprice, 2) FROM orders""",
    "paired_speedup": f"SELECT unit, kind, round(baseline, 6) AS baseline, round(treated, 6) AS treated, round(speedup, 6) AS speedup, round(saved, 6) AS saved FROM ({_PAIRS})",
    "speedup_percentiles": f"SELECT kind, count(*) AS n, round(avg(speedup), 6) AS mean, round(quantile_cont(speedup, 0.1), 6) AS p10, round(quantile_cont(speedup, 0.5), 6) AS median, round(quantile_cont(speedup, 0.9), 6) AS p90 FROM ({_PAIRS}) GROUP BY 1",
    "speedup_share": f"SELECT kind, round(avg(CASE WHEN speedup >= 1 THEN 1.0 ELSE 0 END), 6) AS ge_1_0, round(avg(CASE WHEN speedup >= 1.5 THEN 1.0 ELSE 0 END), 6) AS ge_1_5, round(avg(CASE WHEN speedup >= 2 THEN 1.0 ELSE 0 END), 6) AS ge_2_0 FROM ({_PAIRS}) GROUP BY 1",
    "speedup_histogram": f"SELECT CAST({_BUCKET} AS INT) AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ({_PAIRS}) GROUP BY 1",
    "topk_ratio": f"SELECT unit, round(speedup, 6) AS speedup FROM (SELECT * FROM ({_PAIRS}) ORDER BY speedup DESC, unit LIMIT 25)",
    "status_matrix": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "unit_delta": "SELECT coalesce(a.k, b.k) AS l_partkey, coalesce(a.q, 0) AS before, coalesce(b.q, 0) AS after, coalesce(a.q, 0) - coalesce(b.q, 0) AS saved FROM (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k",
    "kpi_throughput": "SELECT event_type, CAST(floor(3600 / c) AS BIGINT) AS samples, CAST(floor(3600 / k) AS BIGINT) AS checks, round(c / 0.5, 6) AS s_per_pass, CAST(floor(floor(3600 / c) * 8) AS BIGINT) AS cluster_samples FROM (SELECT event_type, avg(value) + 1 AS c, max(value) + 1 AS k FROM events GROUP BY 1)",
    "failure_rate": "SELECT round(avg(CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END), 6) AS failed_share, avg(CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END) > 0.4 AS abort FROM orders",
    "phase_profile": "SELECT event_type AS phase, count(*) AS n, round(sum(value), 6) AS total_ms FROM events GROUP BY 1",
    "pattern_frequency": "SELECT item, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+ing')) AS item FROM documents) GROUP BY 1 ORDER BY n DESC, item LIMIT 10",
    "log_segments": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents),
m AS (SELECT *, regexp_matches(line, '^(The|In|Und|La) ') AS b FROM l),
s AS (SELECT *, max(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS open FROM m)
SELECT doc_id, count(*) AS n_kept, CAST(min(n) AS INT) AS first_line FROM s WHERE b OR (open = 1 AND (starts_with(line, ' ') OR trim(line, ' ') = '')) GROUP BY 1""",
    "section_carry": """SELECT p_partkey, CAST(x.n AS INT) AS n, x.section AS section, x.line AS line FROM (SELECT p_partkey, unnest([
  {'n': 1, 'section': 'package', 'line': 'name = ' || p_name}, {'n': 2, 'section': 'package', 'line': ''}, {'n': 4, 'section': 'features', 'line': 'f' || p_size || ' = []'},
  {'n': 5, 'section': 'features', 'line': '# g = 1'}, {'n': 7, 'section': 'dependencies', 'line': 'x = ' || p_size}]) AS x FROM part)""",
    "byte_offsets": """SELECT doc_id, CAST(octet_length(encode(text)) - octet_length(encode(list_last(string_split(text, chr(10))))) AS BIGINT) AS last_offset, len(string_split(text, chr(10))) AS n_lines FROM documents""",
    "fnv1a_hash": """SELECT p_partkey, lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(p_name, ''), lambda x: CAST(ord(x) AS HUGEINT))),
  lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511628211) % CAST(18446744073709551616 AS HUGEINT)) AS UBIGINT))), 16, '0') AS hash FROM part""",
    "names": "SELECT p_partkey, replace(p_brand || '-' || p_type, '-', '_') AS crate, p_brand || CASE p_size % 3 WHEN 0 THEN '-2d-core' WHEN 1 THEN '' ELSE '-core' END AS unit, substr(md5(p_name), 1, 12) AS plan, lpad(lower(to_hex(p_partkey)), 16, '0') AS key FROM part",
    "cache_hit_miss": f"SELECT hit, count(*) AS n, min(key) AS least_key FROM (SELECT {_SHA} AS key, {_SHA} IN (SELECT {_SHA} FROM part WHERE p_partkey % 3 = 0) AS hit FROM part) GROUP BY 1",
    "staleness_gate": "SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 1 AS fresh FROM orders",
    "session_debounce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n FROM s GROUP BY user_id, k""",
}
