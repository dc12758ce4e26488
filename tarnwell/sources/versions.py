"""Tables kept in immutable versions: a version is a manifest that names the folders of data it consists of.

A writer writes its data into a new folder, which no reader looks at, and then moves a manifest to
the name of the next version. The move fails if the name is taken and is one step of the file system,
so readers see a version wholly or not at all; a job that dies before leaves data that no version
names, which ``vacuum`` removes. Versions are never changed: readers of an older one are not disturbed.

A version that replaces some values of a column only (the crates that were analysed again) names the
folders of the version before as well. Of each value the newest folder that has it counts; which
values a folder has lies beside it as a table, so manifests stay small. ``compact`` writes one folder
in place of many.

The move is atomic on file systems that have a rename which fails for taken names (HDFS, local disks);
on a store without one, a lock of one's own is needed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS, DATA = "versions", "data"


class Conflict(RuntimeError):
    """Another writer took the version's number first."""


@dataclass(frozen=True)
class Version:
    """number from 1 on; by: the column whose values later versions replace, or None; folders: oldest first; parent: 0 for none; schema: as JSON."""

    number: int
    by: str | None
    folders: tuple[str, ...]
    parent: int
    schema: str


class _Files:
    """The file system that holds a path, by way of the session's configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def names(self, *parts: str) -> list[str]:
        where = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> None:
        """A file that appears whole under its name; FileExistsError if the name is taken."""
        draft = self.path(DATA, f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(*parts[:-1]))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.conf).getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(*parts)), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise FileExistsError("/".join(parts)) from None
            raise

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def _name(number: int) -> str:
    return f"{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions, the oldest first."""
    files = _Files(spark, path)
    out = []
    for name in files.names(MANIFESTS):
        held = json.loads(files.read(MANIFESTS, name))
        out.append(Version(held["number"], held["by"], tuple(held["folders"]), held["parent"], held["schema"]))
    return out


def _latest(spark: SparkSession, path: str) -> Version | None:
    every = versions(spark, path)
    return every[-1] if every else None


def write_version(table: DataFrame, path: str, by: str | None = None, after: int | None = None) -> int:
    """Write ``table`` as the next version and return its number.

    by: only the values of this column that ``table`` has are replaced, the rest stays as it was;
    without it the whole table is. after: the number of the version that ``table`` was made from;
    if another one came since, or comes while this one is written, Conflict is raised and nothing is
    visible. Rows with a null in ``by`` are one value.
    """
    spark = table.sparkSession
    before = _latest(spark, path)
    number = before.number if before else 0
    if after is not None and after != number:
        raise Conflict(f"version {number} came after {after}")
    if by and before and before.by not in (None, by):
        raise ValueError(f"versions of {path} replace values of {before.by}, not of {by}")
    plain = lambda schema: sorted((f["name"], json.dumps(f["type"])) for f in json.loads(schema)["fields"])
    if by and before and plain(before.schema) != plain(table.schema.json()):
        raise ValueError("a version that replaces values must have the columns of the one before")
    folder = uuid.uuid4().hex
    table.write.parquet(f"{path}/{DATA}/{folder}/rows")
    if by:
        spark.read.schema(table.schema).parquet(f"{path}/{DATA}/{folder}/rows").select(by).distinct().write.parquet(f"{path}/{DATA}/{folder}/values")
    folders = [*(before.folders if by and before else ()), folder]
    manifest = {"number": number + 1, "by": by, "folders": folders, "parent": number, "schema": table.schema.json()}
    try:
        _Files(spark, path).put(json.dumps(manifest), MANIFESTS, _name(number + 1))
    except FileExistsError:
        raise Conflict(f"version {number + 1} is taken") from None
    return number + 1


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the latest. Later versions don't change what was read."""
    from pyspark.sql.types import StructType

    every = {v.number: v for v in versions(spark, path)}
    if not every or (number is not None and number not in every):
        raise ValueError(f"{path} has no version {'' if number is None else number}".rstrip())
    version = every[max(every) if number is None else number]
    schema = StructType.fromJson(json.loads(version.schema))
    rows = lambda folder: spark.read.schema(schema).parquet(f"{path}/{DATA}/{folder}/rows")
    out = rows(version.folders[-1])
    newer = None
    for k in range(len(version.folders) - 2, -1, -1):
        values = spark.read.schema(StructType([schema[version.by]])).parquet(f"{path}/{DATA}/{version.folders[k + 1]}/values").withColumnRenamed(version.by, "_newer")
        newer = values if newer is None else newer.union(values)
        out = out.union(rows(version.folders[k]).join(newer, F.col(version.by).eqNullSafe(F.col("_newer")), "left_anti"))
    return out


def changes(spark: SparkSession, path: str, old: int, new: int) -> DataFrame:
    """The rows of two versions that are not in both, with ``change`` (removed, added); repeated rows count as often as they are there more."""
    a, b = read_version(spark, path, old), read_version(spark, path, new)
    names = a.columns
    if sorted(names) != sorted(b.columns):
        raise ValueError("the versions have different columns")
    gone, come = a.exceptAll(b.select(*names)), b.select(*names).exceptAll(a)
    return gone.withColumn("change", F.lit("removed")).union(come.withColumn("change", F.lit("added")))


def compact(spark: SparkSession, path: str) -> int:
    """A version with the rows of the latest one in one folder; its number."""
    now = _latest(spark, path)
    if now is None:
        raise ValueError(f"{path} has no version")
    if len(now.folders) == 1:
        return now.number
    number = write_version(read_version(spark, path, now.number), path, None, after=now.number)
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the ``keep`` latest versions, and data that none of these names; the folders that went.

    Data of a write that is still going on would go too, so nothing may be writing.
    """
    files = _Files(spark, path)
    every = versions(spark, path)
    stay = every[-max(keep, 1) :]
    for version in every[: len(every) - len(stay)]:
        files.delete(MANIFESTS, _name(version.number))
    named = {folder for version in stay for folder in version.folders}
    gone = [name for name in files.names(DATA) if name not in named]
    for name in gone:
        files.delete(DATA, name)
    return gone
