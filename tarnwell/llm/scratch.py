"""Working tables in the folder that all executors share.

A job that is used more than once, or that ends a loop step, is written there as Parquet and read
again: this cuts the lineage, and a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "512"
ARROW_BYTES = "8m"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def arrow_batches(spark: SparkSession) -> None:
    """Session settings of the operators; they stay, as results are lazy and run under them.

    Arrow batches handed to Python are bounded by rows and bytes, as whole texts can be long.
    Shuffle files go when the query that made them ends: every step's result is a written table,
    so nothing reads them again, and disk use does not wait for a driver's garbage collection.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


_scope: ContextVar[str | None] = ContextVar("working_tables", default=None)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[str]:
    """A scope whose operators put their working tables into one folder, which goes at its end.

    Results are lazy and read these tables: write them before the scope ends.
    """
    root = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(root)
    try:
        yield root
    finally:
        _scope.reset(token)
        _remove(spark, root)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables of one operator run, under a folder of its own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_scope.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        arrow_batches(spark)

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return it as read back; its folder is ``table.scratch_path``. options: of the writer."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more, to keep the shared folder small."""
        for table in tables:
            _remove(self.spark, table.scratch_path)
