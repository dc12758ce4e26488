from datetime import datetime

from pyspark.sql import functions as F

from tarnwell.functions import scalars
from tarnwell.operators import lines, measurements
from tarnwell.sources import files
from tarnwell.streaming import watch


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, scalars.fnv1a_hex(F.col("s")), s="abc") == "e71fa2190541574b"
    texts = [b"", b"a", b"foobar", *(bytes([k % 256]) * (k * 7 % 50) for k in range(60)), b"long" * 500]
    for text, got in zip(texts, scalars.fnv1a(texts).tolist(), strict=True):
        h = scalars.FNV_OFFSET
        for byte in text:
            h = (h ^ byte) * scalars.FNV_PRIME % (1 << 64)
        assert got == h
    assert len(scalars.fnv1a([])) == 0 and one(spark, scalars.fnv1a_hex(F.col("s").cast("string")), s=None) is None
    got = [one(spark, scalars.without_version(F.col("s")), s=s) for s in ("regex-1.10.2", "foo-bar", "a-b-2x")]
    assert got == ["regex", "foo-bar", "a-b"]
    assert one(spark, scalars.includes(F.col("s")), s='#include <a.h>\n  #include "b/c.h"\n// #include <d>') == ["a.h", "b/c.h"]
    assert one(spark, scalars.frontmatter(F.col("s")), s="#!/usr/bin/x\n\n---\n[package]\n---\nfn main() {}") == "[package]\n"
    assert one(spark, scalars.frontmatter(F.col("s")), s="fn main() {}") is None
    assert one(spark, scalars.with_edition(F.col("s")), s="[package]\nname = 1\n") == '[package]\nedition = "2021"\nname = 1\n'
    assert one(spark, scalars.with_edition(F.col("s")), s="x = 1") == '[package]\nedition = "2021"\nx = 1'
    got = spark.createDataFrame([(0, 100), (4, 1000), (4, 100), (5, 1000)], "s long, n long").select(scalars.skip_decision(F.col("s"), F.col("n")).alias("d"))
    assert [r.d for r in got.collect()] == ["skip", "skip", "cut", "cut"]


def test_measurements(spark):
    k = spark.createDataFrame([(103.0, 12.4), (82.0, 4.1)], "c double, k double").select(measurements.throughput(F.col("c"), F.col("k"), F.lit(1.0), F.lit(1.0), 8).alias("k")).select("k.*").collect()
    assert [(r.samples, r.checks, r.cluster_samples) for r in k] == [(34, 290, 272), (43, 878, 344)]
    unit = "unit string, secs double"
    out = measurements.unit_deltas(spark.createDataFrame([("libc", 1.89), ("globset", 0.92)], unit), spark.createDataFrame([("libc", 1.11), ("globset", 1.98)], unit), "unit", "secs")
    assert {r.unit: round(r.saved, 2) for r in out.collect()} == {"libc": 0.78, "globset": -1.06}
    pairs = spark.createDataFrame([(x,) for x in (0.5, 0.79, 1.0, 1.4, 25.0, None)], "speedup double")
    assert {r.bucket: r.n for r in measurements.histogram(pairs).collect()} == {1: 2, 3: 2, 7: 1}


def test_lines(spark):
    text = "ok\n  early\nwarning: a\n  detail\nnote\n\n   Compiling x\nerror[E1]: b"
    rows = lines.lines_of(spark.createDataFrame([(1, text)], "id long, text string"), "id")
    assert [r.n for r in lines.log_segments(rows, "id").orderBy("n").collect()] == [2, 3, 5, 6, 7]
    assert [r.n for r in lines.log_segments(rows, "id", reset=r"^\s+(Compiling|Finished)").orderBy("n").collect()] == [2, 3, 5, 7]
    manifest = lines.lines_of(spark.createDataFrame([(1, "[package]\nname = 'x'\n[features]\na = []\n# b = 1\nc=['a']\n[dependencies]\nd = 1")], "id long, text string"), "id")
    assert {r.feature for r in lines.features(manifest, "id").collect()} == {"a", "c"}
    log = spark.createDataFrame([("x 12 defined-unmarked",), ("y 30 defined-unmarked",), ("z",)], "line string")
    assert lines.log_sum(log, r"(\d+) defined-unmarked").first().total == 42
    assert lines.log_sum(log.limit(0), r"(\d+) defined-unmarked").first().total == 0
    code = lines.lines_of(spark.createDataFrame([(1, "pub fn a() {\n  let x = 1;\n}\nstruct B {}")], "id long, text string"), "id")
    assert [(r.kind, r.name) for r in lines.item_lines(code).orderBy("n").collect()] == [("fn", "a"), ("struct", "B")]
    assert [r.depth for r in lines.brace_depth(code, "id").orderBy("n").collect()] == [0, 1, 1, 0]


def test_sources(spark, tmp_path):
    (tmp_path / "keep").write_text("# c\n\n0a:0B\nzz:1\nnothing\n0a:0b\n12:34:56\n")
    assert {(r.scid, r.lo) for r in files.read_keep(spark, str(tmp_path / "keep")).collect()} == {("0" * 14 + "0a", "0" * 14 + "0b")}
    (tmp_path / "c.json").write_text('[{"file": "a.c", "directory": "/d", "command": "cc"}, {"file": "/b.c", "directory": "/d", "command": "cc"}]')
    assert {r.path for r in files.read_compile_commands(spark, str(tmp_path / "c.json")).collect()} == {"/d/a.c", "/b.c"}
    (tmp_path / "kv").write_text("a=1\nb=2=3\na=4\nnone")
    assert {(r.key, r.value) for r in files.read_key_values(spark, str(tmp_path / "kv")).collect()} == {("a", "4"), ("b", "2=3")}
    (tmp_path / "m").write_text("SOURCE_HASH: ff\nx::y\n\nx::z\n")
    assert {(r.source_hash, r.item) for r in files.read_marks(spark, str(tmp_path / "m")).collect()} == {("ff", "x::y"), ("ff", "x::z")}
    keep = spark.createDataFrame([("1", "2"), ("1", "1"), ("3", "4")], "scid string, lo string")
    files.write_keep(keep, str(tmp_path / "out"), per_partition=True)
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_debounce_on_batch_and_stream(spark, tmp_path):
    at = lambda ms: datetime(2026, 1, 1, 0, 0, 0, ms * 1000)
    events = spark.createDataFrame([("a", at(0)), ("a", at(300)), ("a", at(900)), ("b", at(0))], "path string, ts timestamp")
    assert sorted((r.path, r.n) for r in watch.debounce(events, "path").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    later = spark.createDataFrame([("c", datetime(2026, 1, 1, 0, 0, 10))], events.schema)  # moves the watermark behind the others
    for part in (events, later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = watch.debounce(stream, "path", lateness="1 second").writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.path, r.n) for r in spark.table("debounced").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_caches(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "crate string, hash string")
    marks = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "0"), ("b", "9"), ("c", None)], "crate string, hash string")
    assert watch.stale(now, marks, "crate", "hash").count() == 3
    assert {r.crate: r.fresh for r in watch.stale(now, marks, "crate", "hash").collect()} == {"a": True, "b": False, "c": False}
    assert {r.crate for r in watch.recompute(now, marks, ["crate", "hash"]).collect()} == {"b", "c"}
