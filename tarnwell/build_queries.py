"""More registered queries: extraction, policies, orders, reports. Built like those of ``queries``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import extraction, graph, lines, measurements, policies
from .queries import _EDGES, _PAIRS, _REACHED, _SAFE, ORACLE_SQL as FIRST_SQL, PART, _dag, _edges, _pairs, _part_items, _reached, _rounded, _spread, _table, _traits, critical_path, unit_delta
from .sources import parsers


def _mono(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").filter("l_quantity < 2").select((F.col("l_partkey") + PART).alias("key"))


def seed_collection(spark, sf_dir):
    taken = _table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select((F.col("l_partkey") + PART).alias("key"))
    return graph.collect_seeds(_part_items(spark, sf_dir), _traits(spark), taken)


def body_edges(spark, sf_dir):
    c = F.col
    facts = _table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("src"),
        F.when(c("l_returnflag") == "A", "call").when(c("l_returnflag") == "R", "closure").otherwise("assign").alias("kind"),
        F.when(c("l_quantity") > 5, c("l_partkey")).alias("target"),
        F.when(c("l_linenumber") == 1, "Use").when(c("l_linenumber") == 2, "BinaryOp").when(c("l_linenumber") == 3, "Aggregate").otherwise("Len").alias("rvalue"),
        F.array(*[F.struct(F.lit(k).alias("kind"), c(n).alias("target")) for k, n in (("fn", "l_partkey"), ("place", "l_orderkey"), ("fn", "l_suppkey"))]).alias("operands"),
    )
    return extraction.body_edges(facts)


def constant_functions(spark, sf_dir):
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    n, k = F.col("n_nationkey").cast("long"), F.col("c_custkey")
    constants = nation.select(n.alias("owner"), (n % 5 == 0).alias("is_generic"), (n % 7 == 0).alias("failed"))
    values = nation.select(n.alias("owner"), F.when(n % 2 == 0, "Pointer").otherwise("Scalar").alias("kind"), F.array(n + 1, n + 2).alias("prov"))
    allocs = customer.select(k.alias("id"), F.when(k % 3 == 0, "Function").otherwise("Memory").alias("kind"), k.alias("target"))
    inner = customer.select(k.alias("src"), (k * 5).alias("dst")).union(customer.select(k, k * 5 + 1))
    return extraction.constant_allocations(constants, values, allocs, inner)[1]


def codegened_items(spark, sf_dir):
    gone = _table(spark, sf_dir, "part").filter("p_size > 20").select((F.col("p_partkey") + PART).alias("key"))
    return graph.codegened(_part_items(spark, sf_dir), gone, _mono(spark, sf_dir))


def forced_elimination(spark, sf_dir):
    forced = _table(spark, sf_dir, "part").filter("p_retailprice > 950").select((F.col("p_partkey") + PART).alias("key"))
    return graph.forced_elimination(_part_items(spark, sf_dir), _reached(spark, sf_dir), forced, _mono(spark, sf_dir), _traits(spark))


def feedback_seeds(spark, sf_dir):
    keep = graph.keep_export(_reached(spark, sf_dir), _part_items(spark, sf_dir), 3)
    return graph.feedback_seeds(keep, _part_items(spark, sf_dir).filter("krate = 5"))


def keep_export(spark, sf_dir):
    return graph.keep_export(_reached(spark, sf_dir), _part_items(spark, sf_dir), 3)


def deletion_levels(spark, sf_dir):
    items, reached, mono = _part_items(spark, sf_dir), _reached(spark, sf_dir), _mono(spark, sf_dir)
    out = None
    for level in policies.LEVEL_TEXT:
        gone = policies.deletable(items, reached, mono, _traits(spark), policies.Policy(level=level)).select(F.lit(level).alias("level"), "key")
        out = gone if out is None else out.union(gone)
    return out.groupBy("level").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"))


def unlinked_functions(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    items = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("crate"), (F.col("p_partkey") % 3 == 0).alias("is_trait_impl"), (F.col("p_size") > 5).alias("is_fn_like"))
    linked = part.filter("p_retailprice > 999").select(F.col("p_name").alias("symbol"))
    return policies.unlinked(items, linked, part.filter("p_brand like '%1'").select(F.col("p_brand").alias("crate")))


def emitted_keep(spark, sf_dir):
    return policies.emitted_keep(_part_items(spark, sf_dir), _mono(spark, sf_dir), _traits(spark))


def trait_calls(spark, sf_dir):
    calls = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("trait_method"), F.col("l_partkey").alias("self_type"))
    impls = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 7 + 1).alias("trait_method"), F.col("p_partkey").alias("self_type"), (F.col("p_partkey") * 10).alias("method"))
    return graph.trait_call_edges(calls, impls)


def dependency_degrees(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.degrees(edges.select(F.col("src").alias("key")).union(edges.select("dst")), edges)


def topological_order(spark, sf_dir):
    weights, deps = _dag(spark, sf_dir)
    roots = weights.filter("key < 0").select("key")
    return graph.topological_order(weights, deps, roots)


def admission_waves(spark, sf_dir):
    return graph.admission(critical_path(spark, sf_dir), 4).select("key", "rank", "wave")


def _ring(spark, sf_dir):
    """Customers in blocks of four: rings in two blocks of three, with edges between some neighbouring blocks, at times both ways."""
    k = F.col("key")
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    block = F.floor(k / 4)
    ring = nodes.filter(block % 3 != 0).select(k.alias("src"), (block * 4 + (k + 1) % 4).alias("dst"))
    on, back = nodes.filter(k % 20 == 0).select(k.alias("src"), (k + 4).alias("dst")), nodes.filter(k % 36 == 20).select(k.alias("src"), (k - 4).alias("dst"))
    return nodes, ring.union(on).union(back)


def cyclic_nodes(spark, sf_dir):
    return graph.cyclic(*_ring(spark, sf_dir))


def cycles_broken(spark, sf_dir):
    return graph.without_cycles(*_ring(spark, sf_dir))


def phase_dependencies(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    deps = customer.select((k / 2).cast("long").alias("src"), k.alias("dst")).filter("src > 0")
    return graph.phase_graph(customer.select(k.alias("unit"), (F.col("c_nationkey") == 0).alias("is_binary")), deps)[1]


def warm_tiers(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    units = part.select("p_partkey", F.col("p_brand").alias("crate"), F.when(F.col("p_size") > 25, F.concat(F.lit("registry+"), "p_name")).alias("source"))
    tiers = part.filter("p_partkey % 50 = 0").select(F.col("p_brand").alias("crate"), (F.col("p_size") % 3 + 1).alias("tier"))
    return graph.with_tier(graph.scheduled(units), tiers).select("p_partkey", "tier")


def size_weights(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(graph.weight_ms(F.col("o_totalprice") * 100), 4).alias("weight_ms"))


def greedy_order(spark, sf_dir):
    """Market segments in the order of what their customers' dependencies have in common."""
    dep = F.col("c_custkey") * F.length("c_mktsegment") % 997
    needs = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project"), dep.cast("string").alias("dep"), (dep % 7 + 1).cast("double").alias("weight"))
    return spark.createDataFrame(list(enumerate(graph.greedy_overlap_order(needs), 1)), "position long, project string")


def elimination_counters(spark, sf_dir):
    items, reached = _part_items(spark, sf_dir), _reached(spark, sf_dir)
    return measurements.elimination_counters(items, reached, graph.eliminable(items, reached, _mono(spark, sf_dir), _traits(spark)), "brand")


def size_reduction(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("long").alias("loc"))
    return _rounded(measurements.size_reduction(part, part.filter("loc <= 20"), "p_brand", "loc"), "percent_removed")


def source_size(spark, sf_dir):
    return measurements.source_size(_table(spark, sf_dir, "documents"), "doc_id")


def repeated_runs(spark, sf_dir):
    return _rounded(measurements.repeated_runs(_table(spark, sf_dir, "events"), "user_id", "value"), "mean", "median")


def round_pairs(spark, sf_dir):
    runs = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, "baseline").otherwise("treated").alias("leg"), "l_quantity")
    return _rounded(measurements.pair_rounds(runs, "l_suppkey", "l_linenumber", "leg", "l_quantity"), "baseline", "treated", "speedup")


def ranked_corpus(spark, sf_dir):
    return measurements.ranked(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey")


def top_and_bottom_units(spark, sf_dir):
    return measurements.top_and_bottom(unit_delta(spark, sf_dir), "saved", "l_partkey").select("l_partkey", "saved", "side")


def newest_rows(spark, sf_dir):
    return measurements.newest(_table(spark, sf_dir, "events"), "ts", "event_id", 20).select("event_id", "event_type")


def overhead_labels(spark, sf_dir):
    pair = measurements.with_overhead(F.col("baseline"), F.col("treated"), F.lit(2.0)).alias("x")
    return _rounded(_pairs(spark, sf_dir).select("unit", pair).select("unit", "x.end_to_end", "x.label"), "end_to_end")


def routes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", scalars.route(F.concat(F.when(F.col("page_id") % 3 == 0, "/vendor/").otherwise("/src/"), "url"), F.col("page_id") % 7 == 0).alias("route"))


def daemon_decisions(spark, sf_dir):
    per = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("files"), F.sum("o_totalprice").alias("lines"))
    return per.select("o_custkey", scalars.daemon_decision(F.when(F.col("o_custkey") % 10 == 0, True), F.col("files") * 10, F.col("lines") / 10).alias("daemon"))


def log_numbers(spark, sf_dir):
    return lines.log_sum(lines.lines_of(_table(spark, sf_dir, "documents"), "doc_id"), r"([0-9]+) ").select(F.col("total").cast("string").alias("total"))


def log_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.when(F.col("o_orderstatus") == "F", "error:").when(F.col("o_orderstatus") == "P", "warning:").otherwise("note:"), F.when(F.col("o_orderkey") % 3 == 0, "3 warnings generated").otherwise("x")).alias("line"))
    return lines.diagnostic_counts(rows)


def feature_split(spark, sf_dir):
    name = lambda t, c: _table(spark, sf_dir, t).select(F.col(c).cast("string").alias("feature")).distinct()
    here, missing = lines.missing_features(name("supplier", "s_nationkey"), name("customer", "c_nationkey").filter("feature < '2'"))
    return here.select("feature", F.lit(True).alias("supported")).union(missing.select("feature", F.lit(False)))


def merged_values(spark, sf_dir):
    row = lambda t, k, v: _table(spark, sf_dir, t).groupBy(F.col(k).alias("key")).agg(F.max(v).alias("value"))
    return lines.merged(row("customer", "c_nationkey", "c_acctbal"), row("supplier", "s_nationkey", "s_acctbal"), "key", "value")


def parsed_calls(spark, sf_dir):
    """Calls between functions of generated sources: each part's function calls that of the part with twice its key."""
    p = F.col("p_partkey")
    code = F.concat(F.lit("fn p"), p, F.lit("(x: u8) { /* p0() */ p"), p * 2, F.lit("(\"p1()\"); }"))
    facts = parsers.parse_sources(_spread(_table(spark, sf_dir, "part").select("p_partkey", "p_brand")).select("p_brand", code.alias("text")), "p_brand")
    items, calls = parsers.call_graph(facts, "p_brand")
    caller, callee = items.select(F.col("id").alias("src"), F.col("name").alias("caller")), items.select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    return calls.join(caller, "src").join(callee, "dst").select("caller", "callee")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        seed_collection, body_edges, constant_functions, codegened_items, forced_elimination, feedback_seeds, keep_export, deletion_levels,
        unlinked_functions, emitted_keep, trait_calls, dependency_degrees, topological_order, admission_waves, cyclic_nodes, cycles_broken,
        phase_dependencies, warm_tiers, size_weights, greedy_order, elimination_counters, size_reduction, source_size, repeated_runs,
        round_pairs, ranked_corpus, top_and_bottom_units, newest_rows, overhead_labels, routes, daemon_decisions, log_numbers, log_counts,
        feature_split, merged_values, parsed_calls,
    )
}

_KEY = f"p_partkey + {PART}"
_UNREACHED = f"{_KEY} NOT IN (SELECT key FROM r)"
_UNMADE = "p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)"
_GONE = f"{_SAFE} AND {_UNREACHED} AND {_UNMADE}"
_RING = """k AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), e AS (
  SELECT k AS src, k // 4 * 4 + (k + 1) % 4 AS dst FROM k WHERE k // 4 % 3 <> 0 UNION SELECT k, k + 4 FROM k WHERE k % 20 = 0 UNION SELECT k, k - 4 FROM k WHERE k % 36 = 20
), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst), pair AS (SELECT a.src, a.dst FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src)"""
_DELTA = FIRST_SQL["unit_delta"]


def _level(number: int, condition: str) -> str:
    return f"SELECT {number} AS level, {_KEY} AS key FROM part WHERE {condition}"


def _greedy_sql(steps: int) -> str:
    """Greedy order unrolled: in each step the project left with most weight in common with what is built, ties by name."""
    out = """WITH n AS (SELECT DISTINCT c_mktsegment AS p, c_custkey * length(c_mktsegment) % 997 AS d FROM customer), w AS (SELECT p, d, CAST(d % 7 + 1 AS DOUBLE) AS w FROM n),
s1 AS (SELECT p FROM (SELECT p, sum(w) AS g FROM w GROUP BY 1) ORDER BY g DESC, p LIMIT 1)"""
    for k in range(2, steps + 1):
        done = " UNION ALL ".join(f"SELECT p FROM s{j}" for j in range(1, k))
        out += f""",
s{k} AS (SELECT p FROM (SELECT p, coalesce(sum(w) FILTER (d IN (SELECT d FROM w WHERE p IN ({done}))), 0) AS g FROM w WHERE p NOT IN ({done}) GROUP BY 1) ORDER BY g DESC, p LIMIT 1)"""
    return out + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS position, p AS project FROM s{k}" for k in range(1, steps + 1))


_PRIVATE_OTHER = f"p_partkey % 2 = 0 AND p_size <= 5 AND {_UNREACHED} AND {_UNMADE}"

ORACLE_SQL: dict[str, str] = {
    "seed_collection": f"SELECT {_KEY} AS key FROM part WHERE p_size > 40 OR p_partkey % 29 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 5 IN (1, 2)) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "body_edges": """SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 5
UNION SELECT l_orderkey, unnest([l_partkey, l_suppkey]) FROM lineitem WHERE l_returnflag = 'A'
UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') AND l_linenumber <= 3
UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') AND l_linenumber = 3""",
    "constant_functions": """WITH RECURSIVE m AS (
  SELECT CAST(unnest([n_nationkey + 1, n_nationkey + 2]) AS BIGINT) AS id FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AND n_nationkey % 2 = 0
  UNION SELECT unnest([m.id * 5, m.id * 5 + 1]) FROM m JOIN customer ON c_custkey = m.id WHERE m.id % 3 <> 0
) SELECT DISTINCT c_custkey AS key FROM m JOIN customer ON c_custkey = id WHERE id % 3 = 0""",
    "codegened_items": f"SELECT {_KEY} AS key, CASE WHEN p_size > 20 THEN false ELSE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2) END AS codegened FROM part",
    "forced_elimination": f"{_REACHED} SELECT {_KEY} AS key FROM part WHERE {_GONE} AND NOT p_retailprice > 950",
    "feedback_seeds": f"{_REACHED} SELECT key FROM r JOIN part ON key = {_KEY} WHERE p_partkey % 7 = 5",
    "keep_export": f"{_REACHED} SELECT CAST(p_partkey % 7 AS VARCHAR) AS scid, CAST(p_partkey AS VARCHAR) AS lo FROM r JOIN part ON key = {_KEY} WHERE p_partkey % 7 <> 3",
    "deletion_levels": f"{_REACHED}, x AS ({_level(1, f'{_GONE} AND p_partkey % 2 = 0')} UNION ALL {_level(2, f'({_GONE} AND p_partkey % 2 = 0) OR ({_PRIVATE_OTHER})')} UNION ALL {_level(3, f'({_GONE}) OR ({_PRIVATE_OTHER})')} UNION ALL {_level(4, _UNREACHED)}) SELECT CAST(level AS INT) AS level, count(*) AS n, min(key) AS least, max(key) AS greatest FROM x GROUP BY 1",
    "unlinked_functions": "SELECT p_partkey AS key FROM part WHERE p_partkey % 3 <> 0 AND p_size > 5 AND p_brand NOT LIKE '%1' AND p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice > 999)",
    "emitted_keep": f"SELECT CAST(p_partkey % 7 AS VARCHAR) AS scid, CAST(p_partkey AS VARCHAR) AS lo FROM part WHERE p_size > 5 AND NOT ({_SAFE} AND {_UNMADE})",
    "trait_calls": "SELECT DISTINCT l_orderkey AS src, p_partkey * 10 AS dst FROM lineitem JOIN part ON p_partkey = l_partkey AND p_partkey % 7 + 1 = l_linenumber",
    "dependency_degrees": f"WITH e AS ({_EDGES}), x AS (SELECT src AS key, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT key, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM x GROUP BY 1",
    "topological_order": FIRST_SQL["topo_levels"].rsplit("SELECT CAST(level", 1)[0] + "SELECT key, position FROM (SELECT key, row_number() OVER (ORDER BY level, key) AS position FROM every) WHERE key >= 0",
    "admission_waves": f"SELECT key, rank, (rank - 1) // 4 + 1 AS wave FROM (SELECT key, row_number() OVER (ORDER BY cp DESC, key) AS rank FROM ({FIRST_SQL['critical_path']}))",
    "cyclic_nodes": f"WITH RECURSIVE {_RING} SELECT k AS key FROM k WHERE k IN (SELECT src FROM pair)",
    "cycles_broken": f"WITH RECURSIVE {_RING} SELECT src, dst FROM e WHERE dst < src OR (src, dst) NOT IN (SELECT (src, dst) FROM pair)",
    "phase_dependencies": """WITH u AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_nationkey = 0 AS b FROM customer), d AS (SELECT k // 2 AS s, k AS t FROM u WHERE k > 1)
SELECT k * 4 + 1 AS src, k * 4 AS dst FROM u UNION SELECT k * 4 + 1, k * 4 + 2 FROM u WHERE NOT b UNION SELECT k * 4 + 2, k * 4 FROM u WHERE b
UNION SELECT s * 4, t * 4 FROM d UNION SELECT t * 4 + 2, s * 4 + 2 FROM d""",
    "warm_tiers": "SELECT p_partkey, t.tier FROM part LEFT JOIN (SELECT p_brand AS b, CAST(min(p_size % 3 + 1) AS INT) AS tier FROM part WHERE p_partkey % 50 = 0 GROUP BY 1) t ON t.b = p_brand WHERE p_size <= 25",
    "size_weights": "SELECT o_orderkey, round(least(greatest(o_totalprice * 100 / 350.0, 100.0), 60000.0), 4) AS weight_ms FROM orders",
    "greedy_order": _greedy_sql(5),
    "elimination_counters": f"{_REACHED} SELECT p_brand AS brand, count(*) FILTER (p_size > 5) AS total_fn_like, count(*) FILTER (p_size > 40) AS reachable_set, count(*) FILTER ({_KEY} IN (SELECT key FROM r)) AS post_bfs, count(*) FILTER ({_GONE}) AS eliminated FROM part GROUP BY 1",
    "size_reduction": "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS before, CAST(coalesce(sum(p_size) FILTER (p_size <= 20), 0) AS BIGINT) AS after, round(100.0 * (sum(p_size) - coalesce(sum(p_size) FILTER (p_size <= 20), 0)) / sum(p_size), 6) AS percent_removed FROM part GROUP BY 1",
    "source_size": "SELECT count(*) AS files, CAST(coalesce(sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END), 0) AS BIGINT) AS lines FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 600)",
    "repeated_runs": "SELECT user_id, count(value) AS runs, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1",
    "round_pairs": "SELECT l_suppkey, l_linenumber, round(b, 6) AS baseline, round(t, 6) AS treated, round(b / t, 6) AS speedup FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity) FILTER (l_orderkey % 2 = 0) AS b, avg(l_quantity) FILTER (l_orderkey % 2 <> 0) AS t FROM lineitem GROUP BY 1, 2) WHERE b IS NOT NULL AND t IS NOT NULL AND t <> 0",
    "ranked_corpus": "SELECT p_partkey, p_brand, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part",
    "top_and_bottom_units": f"SELECT l_partkey, saved, 'saved' AS side FROM (SELECT * FROM ({_DELTA}) ORDER BY saved DESC, l_partkey LIMIT 10) UNION ALL SELECT l_partkey, saved, 'regressed' FROM (SELECT * FROM ({_DELTA}) ORDER BY saved, l_partkey LIMIT 5)",
    "newest_rows": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20",
    "overhead_labels": f"SELECT unit, round(baseline / (treated + 2), 6) AS end_to_end, CASE WHEN baseline / (treated + 2) >= 1 THEN 'saved' ELSE 'overhead' END AS label FROM ({_PAIRS})",
    "routes": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'compiler' WHEN page_id % 3 = 0 OR regexp_matches(url, '/(registry|git|vendor)/') THEN 'cache' ELSE 'driver' END AS route FROM pages",
    "daemon_decisions": "SELECT o_custkey, o_custkey % 10 = 0 OR (count(*) * 10 > 150 AND sum(o_totalprice) / 10 > 150000) AS daemon FROM orders GROUP BY 1",
    "log_numbers": "SELECT CAST(coalesce(sum(TRY_CAST(x AS DECIMAL(38, 0))), 0) AS VARCHAR) AS total FROM (SELECT unnest(regexp_extract_all(line, '([0-9]+) ', 1)) AS x FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))",
    "log_counts": "SELECT count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 3 <> 0) AS warnings, count(*) FILTER (o_orderstatus = 'F') AS errors FROM orders",
    "feature_split": "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS feature, CAST(s_nationkey AS VARCHAR) IN (SELECT CAST(c_nationkey AS VARCHAR) FROM customer WHERE CAST(c_nationkey AS VARCHAR) < '2') AS supported FROM supplier",
    "merged_values": "SELECT coalesce(s.k, c.k) AS key, CASE WHEN s.k IS NOT NULL THEN s.v ELSE c.v END AS value FROM (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1) s ON s.k = c.k",
    "parsed_calls": "SELECT 'p' || a.p_partkey AS caller, 'p' || b.p_partkey AS callee FROM part a JOIN part b ON b.p_partkey = 2 * a.p_partkey AND b.p_brand = a.p_brand",
}
