"""Helpers shared by the training-data operators: scratch tables, names, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a regex class body: space and tab to carriage return.
WS = r"\x20\x09-\x0D"
#: A word is a maximal run of anything else.
WORD = rf"[^{WS}]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, in local mode only:
    on a cluster a folder of one machine would lose data with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


#: Paths written within the open :func:`finished` of this thread, which deletes them.
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """``df`` as Parquet at a path, read again."""
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts lineage: later passes read the table and survive lost executors.
    """
    path = scratch_path(df.sparkSession, tag)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return written(df, path, *partition_by)


def finished(spark: SparkSession, tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``make``; the tables that were stored on the way are deleted, as nothing reads them any more."""
    path, own = scratch_path(spark, tag), []
    if (outer := _scope.get()) is not None:
        outer.append(path)
    token = _scope.set(own)
    try:
        return written(make(), path)
    finally:
        _scope.reset(token)
        for x in own:
            drop_path(spark, x)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of text in an Arrow batch: what a Python worker holds at once, beside what it makes of them.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``, as rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def mapped(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: Spark itself does not find names with dots there."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    given, numbered = df.columns, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches):
        for out in run(b.rename_columns(given) for b in batches):
            yield out.rename_columns(numbered.names)

    small_batches(df.sparkSession)
    return df.toDF(*(f"c{i}" for i in range(len(given)))).mapInArrow(renamed, numbered).toDF(*schema.names)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    """A text column with null taken as the empty text."""
    return F.coalesce(col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """The number of words in a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, f"[{WS}]+", -1), "")


def hash60(key: Column) -> Column:
    """The first 60 bits of a key's MD5 as a non-negative long; any engine with MD5 can repeat it."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, even where lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0, 1, ... n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
