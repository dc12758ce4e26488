"""Paired measurements: speedups, percentiles, shares, histograms, deltas, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .ranks import quantiles

# Bucket edges of the speedup histogram.
EDGES = (0.5, 0.8, 1.0, 1.5, 2.0, 5.0, 20.0)


def pair_legs(runs: DataFrame, unit: str, leg: str, value: str) -> DataFrame:
    """(unit, baseline, treated, speedup, saved) of units with both legs, by one conditional aggregation."""
    sums = runs.groupBy(unit).agg(F.avg(F.when(F.col(leg) == "baseline", F.col(value))).alias("baseline"), F.avg(F.when(F.col(leg) == "treated", F.col(value))).alias("treated"))
    both = sums.filter("baseline is not null and treated is not null and treated <> 0")
    return both.select(unit, "baseline", "treated", (F.col("baseline") / F.col("treated")).alias("speedup"), (F.col("baseline") - F.col("treated")).alias("saved"))


def with_overhead(baseline: Column, treated: Column, overhead: Column) -> Column:
    """struct(end_to_end, label) of a pair when preparing costs ``overhead``."""
    ratio = F.try_divide(baseline, treated + overhead)
    return F.struct(ratio.alias("end_to_end"), F.when(ratio >= 1, "saved").otherwise("overhead").alias("label"))


def percentiles(pairs: DataFrame, group: str, value: str = "speedup") -> DataFrame:
    """(group, n, mean, p10, median, p90), interpolated; by rank selection over ranges, so groups may be of any size."""
    base = pairs.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    found = quantiles(pairs, group, value, {"p10": 0.1, "median": 0.5, "p90": 0.9}).withColumnRenamed(group, "_of")
    return base.join(found, F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")


def shares(pairs: DataFrame, group: str, value: str = "speedup", thresholds: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """Share of rows at or above each threshold: columns ge_1_0 and so on."""
    return pairs.groupBy(group).agg(*[F.avg(F.when(F.col(value) >= t, 1.0).otherwise(0.0)).alias("ge_" + str(t).replace(".", "_")) for t in thresholds])


def histogram(pairs: DataFrame, value: str = "speedup", edges: tuple[float, ...] = EDGES) -> DataFrame:
    """(bucket, n, percent) over half-open buckets; bucket counts the edges at or below a value."""
    bucket = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = pairs.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("bucket", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def status_matrix(rows: DataFrame, kind: str, status: str) -> DataFrame:
    return rows.groupBy(kind, status).agg(F.count("*").alias("n"))


def top(rows: DataFrame, value: str, tie: str, n: int = 25) -> DataFrame:
    """The ``n`` rows of largest ``value``; equals by ``tie``."""
    return rows.orderBy(F.col(value).desc(), F.col(tie)).limit(n)


def unit_deltas(before: DataFrame, after: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, before, after, saved) over both builds; a unit missing on a side counts 0 there."""
    both = before.select(unit, F.col(value).alias("before")).join(after.select(unit, F.col(value).alias("after")), unit, "full_outer")
    both = both.select(unit, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return both.withColumn("saved", F.col("before") - F.col("after"))


def gap(visible: Column, reached: Column) -> Column:
    """Share of what is visible that is not reached; null when nothing is visible."""
    return F.try_divide(visible - reached, visible)


def throughput(compile_s: Column, check_s: Column, pass_rate: Column, samples_share: Column, gpus: int) -> Column:
    """struct of the four throughput figures: samples and checks an hour, seconds for each pass, samples of a cluster an hour."""
    an_hour = F.floor(3600 / compile_s)
    return F.struct(an_hour.alias("samples"), F.floor(3600 / check_s).alias("checks"), F.try_divide(compile_s, pass_rate).alias("s_per_pass"), F.floor(an_hour * gpus * samples_share).alias("cluster_samples"))


def over_failure_rate(results: DataFrame, most: float) -> DataFrame:
    """(failed_share, abort) over results (success)."""
    share = F.avg(F.when(F.col("success"), 0.0).otherwise(1.0))
    return results.agg(share.alias("failed_share"), (share > most).alias("abort"))


def phase_profile(timings: DataFrame) -> DataFrame:
    """(phase, n, total_ms) of (phase, ms)."""
    return timings.groupBy("phase").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"))


def elimination_counters(items: DataFrame, reached: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """(by, total_fn_like, reachable_set, post_bfs, eliminated) of local items: one row a partition."""
    marked = items.filter("is_local").join(reached.select("key", F.lit(True).alias("hit")).distinct(), "key", "left").join(gone.select("key", F.lit(True).alias("gone")).distinct(), "key", "left")
    return marked.groupBy(by).agg(
        F.count_if(F.col("is_fn_like")).alias("total_fn_like"), F.count_if(F.col("in_reachable_set")).alias("reachable_set"),
        F.count("hit").alias("post_bfs"), F.count("gone").alias("eliminated"),
    )


def size_reduction(before: DataFrame, after: DataFrame, by: str, size: str) -> DataFrame:
    """(by, before, after, percent_removed): summed sizes on both sides; a side without rows counts 0, no size before: null."""
    both = before.select(by, F.col(size).alias("b"), F.lit(None).cast("long").alias("a")).union(after.select(by, F.lit(None).cast("long"), F.col(size)))
    out = both.groupBy(by).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("before"), F.coalesce(F.sum("a"), F.lit(0)).alias("after"))
    return out.withColumn("percent_removed", F.try_divide(100.0 * (F.col("before") - F.col("after")), F.col("before")))


def source_size(texts: DataFrame, order: str, most: int = 600, text_col: str = "text") -> DataFrame:
    """(files, lines) of the first ``most`` texts in ``order``; a text's last line counts without a line end, null texts have none."""
    body = F.col(text_col)
    count = F.when(body.isNull() | (body == ""), 0).otherwise(F.size(F.split(body, "\n")) - F.when(body.endswith("\n"), 1).otherwise(0))
    return texts.orderBy(order).limit(most).agg(F.count("*").alias("files"), F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("lines"))


def repeated_runs(runs: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, runs, mean, median) over repeated runs; null values are no runs. By rank selection, as in ``percentiles``."""
    base = runs.groupBy(unit).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"))
    found = quantiles(runs, unit, value, {"median": 0.5}).withColumnRenamed(unit, "_of")
    return base.join(found, F.col(unit).eqNullSafe(F.col("_of")), "left").drop("_of")


def pair_rounds(runs: DataFrame, unit: str, round_: str, leg: str, value: str) -> DataFrame:
    """(unit, round, baseline, treated, speedup) of interleaved rounds: legs are paired inside a round."""
    sums = runs.groupBy(unit, round_).agg(F.avg(F.when(F.col(leg) == "baseline", F.col(value))).alias("baseline"), F.avg(F.when(F.col(leg) == "treated", F.col(value))).alias("treated"))
    both = sums.filter("baseline is not null and treated is not null and treated <> 0")
    return both.withColumn("speedup", F.col("baseline") / F.col("treated"))


def ranked(rows: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """``rows`` with ``rank``: 1 for the largest value of its group; ties by ``tie``, nulls last. By ranges, so groups may be of any size."""
    return ranks.ranked(rows, group, [F.col(value).desc_nulls_last(), F.col(tie)])


def top_and_bottom(rows: DataFrame, value: str, tie: str, best: int = 10, worst: int = 5) -> DataFrame:
    """The ``best`` rows of largest value and the ``worst`` of smallest, with ``side``; null values are left out."""
    known = rows.filter(F.col(value).isNotNull())
    top_ = known.orderBy(F.col(value).desc(), F.col(tie)).limit(best).withColumn("side", F.lit("saved"))
    return top_.union(known.orderBy(F.col(value), F.col(tie)).limit(worst).withColumn("side", F.lit("regressed")))


def newest(rows: DataFrame, ts: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` latest rows; ties by ``tie``."""
    return rows.orderBy(F.col(ts).desc_nulls_last(), F.col(tie)).limit(n)


def status_label(success: Column) -> Column:
    return F.when(success, "OK").otherwise("FAIL")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """(name, duration_secs, status, speedup) over runs (name, duration_secs, success): speedup against the run named baseline."""
    base = runs.filter("name = 'baseline' and success").agg(F.min("duration_secs").alias("base"))  # one row
    return runs.crossJoin(F.broadcast(base)).select("name", "duration_secs", status_label(F.col("success")).alias("status"), F.when(F.col("success"), F.try_divide("base", "duration_secs")).alias("speedup"))
