"""Versioned tables: what readers see while writers write, die and compete."""

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import versions as v


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "crate string, mark long")


def test_versions_stay_as_they_were(spark, path):
    assert v.write_version(table(spark, ("a", 1), ("b", 2), (None, 3)), path, "crate") == 1
    assert v.write_version(table(spark, ("b", 20), ("c", 30)), path, "crate") == 2
    assert v.write_version(table(spark, (None, 4), (None, 4)), path, "crate", after=2) == 3
    assert rows(v.read_version(spark, path, 1)) == [("a", 1), ("b", 2), (None, 3)]
    assert rows(v.read_version(spark, path, 2)) == [("a", 1), ("b", 20), ("c", 30), (None, 3)]
    want = [("a", 1), ("b", 20), ("c", 30), (None, 4), (None, 4)]
    assert rows(v.read_version(spark, path)) == want
    assert rows(v.changes(spark, path, 1, 3)) == sorted([("b", 2, "removed"), (None, 3, "removed"), ("b", 20, "added"), ("c", 30, "added"), (None, 4, "added"), (None, 4, "added")], key=str)
    assert v.compact(spark, path) == 4 and v.compact(spark, path) == 4
    assert rows(v.read_version(spark, path)) == want == rows(v.read_version(spark, path, 3))
    assert len(v.versions(spark, path)[-1].folders) == 1
    assert v.write_version(table(spark, ("z", 0)), path) == 5
    assert rows(v.read_version(spark, path)) == [("z", 0)]
    assert len(v.vacuum(spark, path, keep=1)) == 4
    assert rows(v.read_version(spark, path)) == [("z", 0)] and [x.number for x in v.versions(spark, path)] == [5]
    with pytest.raises(ValueError):
        v.read_version(spark, path, 1)


def test_a_write_that_dies_shows_nothing(spark, path):
    v.write_version(table(spark, ("a", 1)), path, "crate")
    broken = spark.range(40).select(F.lit("a").alias("crate"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("mark"))
    with pytest.raises(Exception, match="lost"):
        v.write_version(broken, path, "crate")
    assert rows(v.read_version(spark, path)) == [("a", 1)] and len(v.versions(spark, path)) == 1
    assert len(v.vacuum(spark, path)) == 1
    assert rows(v.read_version(spark, path)) == [("a", 1)]
    assert v.write_version(table(spark, ("a", 2)), path, "crate") == 2


def test_the_second_of_two_writers_is_told(spark, path, monkeypatch):
    v.write_version(table(spark, ("a", 1)), path, "crate")
    with pytest.raises(v.Conflict):
        v.write_version(table(spark, ("a", 2)), path, "crate", after=0)
    latest = v._latest

    def late(spark, path):
        """Another writer's version comes between this writer's look and its move."""
        now = latest(spark, path)
        monkeypatch.setattr(v, "_latest", latest)
        v.write_version(table(spark, ("b", 9)), path, "crate")
        return now

    monkeypatch.setattr(v, "_latest", late)
    with pytest.raises(v.Conflict):
        v.write_version(table(spark, ("a", 5)), path, "crate")
    assert rows(v.read_version(spark, path)) == [("a", 1), ("b", 9)]


def test_columns_and_names_are_checked(spark, path):
    with pytest.raises(ValueError):
        v.read_version(spark, path)
    v.write_version(table(spark, ("a", 1)), path, "crate")
    with pytest.raises(ValueError):
        v.write_version(table(spark, ("a", 1)), path, "mark")
    with pytest.raises(ValueError):
        v.write_version(table(spark, ("a", 1)).withColumn("more", F.lit(1)), path, "crate")
    v.write_version(table(spark), path, "crate")  # nothing is replaced
    assert rows(v.read_version(spark, path)) == [("a", 1)]
