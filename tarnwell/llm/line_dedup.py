"""Removal of repeated runs of lines: overlapping windows of three lines, first occurrence kept.

A window is three consecutive lines of one document, known by two independent 64-bit hashes.
Windows are grouped globally (with partial minima before the shuffle); of a window that occurs more
than once, every occurrence but the first in (document, line) order goes, and the positions such
windows cover are merged by document. Only hashes and positions are grouped; a frequent window is a
skewed key of the join that marks its occurrences, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with all columns, ``text_col`` without repeated lines, and n_lines, n_removed.

    Lines end at a line feed and count as they are; windows of three blank lines are no windows. A
    line goes if it lies in an occurrence that is not the first one of its window. Windows are
    judged on the input. Null texts stay null with 0 lines; texts of one or two lines are unchanged.
    Rows with a null id are returned whole and take nothing from others. Rows that repeat both id
    and text are one document and each returned; rows that repeat an id with other texts are
    ordered by a hash of the text. Columns named like the added ones are replaced;
    without ``counts`` none are added and all of the caller's stay.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(id_.alias("id"), F.xxhash64(text).alias("version"), F.split(text, "\n").alias("lines")).filter("id is not null")
    hashes = F.expr(
        f"transform(sequence(0, size(lines) - {WINDOW}), i -> struct(i as at,"
        " xxhash64(lines[i], 1, lines[i + 1], 2, lines[i + 2]) as first,"
        " xxhash64(3, lines[i + 2], 4, lines[i], 5, lines[i + 1]) as second,"
        " trim(lines[i]) = '' and trim(lines[i + 1]) = '' and trim(lines[i + 2]) = '' as blank))"
    )
    windows = (
        rows.filter(F.size("lines") >= WINDOW)
        .select("id", "version", F.explode(hashes).alias("w"))
        .filter("not w.blank")
        .select("w.first", "w.second", F.struct("id", "version", "w.at").alias("place"))
    )
    repeated = (
        windows.groupBy("first", "second").agg(F.min("place").alias("earliest"), F.max("place").alias("latest")).filter("earliest <> latest").select("first", "second", "earliest")
    )
    later = windows.join(repeated, ["first", "second"]).filter("place > earliest").select("place.*")
    marks = later.groupBy("id", "version").agg(F.collect_set("at").alias("marks"))

    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    base = docs.select(F.struct(*names).alias("row"), id_.alias("id"), F.xxhash64(text).alias("version"))
    joined = base.join(marks.hint("shuffle_hash"), ["id", "version"], "left")
    lines = F.split(F.col("row")[text_col], "\n")
    covered = F.flatten(F.transform("marks", lambda at: F.array(*[at + k for k in range(WINDOW)])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = joined.withColumn("lines", lines).withColumn("kept", F.when(F.col("marks").isNotNull(), kept))
    new_text = F.when(F.col("kept").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"))
    added = (
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )
    return out.select(*[(new_text if c == text_col else F.col("row")[c]).alias(c) for c in names], *(added if counts else ()))
