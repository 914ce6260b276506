"""Shared helpers: reading tables, the shared folder, column names, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as a plain character list, for translate().
BLANKS = " \t\n\x0b\f\r"

_own: list[str] = []
Tables = list[tuple[SparkSession, str]]
_of_process: Tables = []
#: Shuffle files of a query go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where written() notes its tables, the innermost list last.
_scopes: ContextVar[tuple[Tables, ...]] = ContextVar("scopes", default=(_of_process,))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it isn't set, a temporary one in
    local mode (tests), else an error, as executors elsewhere couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own[0] if _own else tempfile.mkdtemp(prefix="hypso-shared-")
        _own[:] = [folder]
    return folder


def written(df: DataFrame, outer: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Unlike a checkpoint it doesn't carry on the constraints that the optimizer infers, which in
    loops grow until planning takes minutes and the driver's memory. Removed at the end of the scratch() it
    is made in (outer: of the one so many around that), or when the process ends. What was shuffled for
    it is removed at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hypso-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    scopes[-min(1 + outer, len(scopes))].append((spark, path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted(tables: Tables) -> Iterator[None]:
    """Tables that are written here are noted in this list."""
    token = _scopes.set((*_scopes.get(), tables))
    try:
        yield
    finally:
        _scopes.reset(token)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written here are removed at the end."""
    tables: Tables = []
    try:
        with noted(tables):
            yield
    finally:
        remove(tables)


def remove(tables: Tables) -> None:
    """Remove the tables of the list, and empty it."""
    gone, tables[:] = tables[:], []
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            continue


def keep(tables: Tables) -> None:
    """Leave the tables of the list to the list around it, or to the end of the process."""
    _scopes.get()[-1].extend(tables)


atexit.register(remove, _of_process)


def exact(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def with_row(rows: DataFrame, added: str) -> StructType:
    """The schema of rows' `_row` and the fields of a DDL text."""
    return StructType([rows.schema["_row"], *StructType.fromDDL(added)])


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas re-evaluate what they capture."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Rows with whole texts go to Python in batches of so many rows and bytes at most, so that a
    worker's memory is bounded by the longest text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
