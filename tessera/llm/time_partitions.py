"""Time partitions that follow the data, as Parquet files of a bounded number of rows.

Rows are counted by hour. ``applyInPandas`` plans the months, days and hours of
each year's histogram independently of the others, as if the year had to be
divided: a node above the limit is divided into all its months, days or hours;
siblings within the limit are put together in time order while the sum stays
within it. A last small pass does the same with the years, from the first to the
last, and drops the subplans of years that need not be divided. What these
passes see is bounded by the calendar: a year has 8,784 hours at most.

A leaf is written as parts of at most the limit. Leaves within it are one part
as they are. The rows of the others, hours above the limit and rows without a
moment, are put in order by ranges and stored; a row's place in its leaf is its
place in its file and the rows of the files before, so that no leaf meets in a
task. A part is one file, by contract, and is written by one task in order.

:func:`rewrite` compares the parts of a table with those that stand in the
folder, by leaf, part, number of rows and two 64-bit sums of hashes of all columns
(the order of a part follows from its rows), and writes only those that differ.

Defined results: rows without a moment are the leaf ``null``; nulls come first in
the order of a part; rows equal in moment and ``order`` are ordered by the other
columns; repeated rows are rows of their own; an empty table leaves no file; a
table may have columns of any name but those of the folders, ``time_leaf`` and
``time_part``, and of types that can be sorted.
"""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterator
from datetime import datetime, timedelta
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, drop_path, fresh, mapped, partitions, scratch_path, stored

#: The hour of rows without a moment.
NO_HOUR = -(1 << 40)
#: Hours, or files, that are broadcast at most; more are joined by a shuffle.
BROADCAST_HOURS, BROADCAST_FILES = 2_000_000, 200_000
#: Columns of the folders: the leaf with dots for slashes, and the part.
LEAF, PART = "time_leaf", "time_part"
EPOCH = datetime(1970, 1, 1)


def runs(sizes: list[int], limit: int) -> list[tuple[int, int] | None]:
    """For each of some siblings the first and last of its run, or None for one above the limit."""
    out: list = []
    total = None
    for i, n in enumerate(sizes):
        if n > limit:
            out.append(None)
            total = None
        elif total is not None and total + n <= limit:
            out.append((out[-1][0], i))
            total += n
        else:
            out.append((i, i))
            total = n
    for i in range(len(out) - 2, -1, -1):
        if out[i] and out[i + 1] and out[i + 1][0] == out[i][0]:
            out[i] = out[i + 1]
    return out


def year_plan(year: int, hours: dict[int, int], limit: int) -> dict[int, str]:
    """The leaf of each hour (since 1970) of a year that is divided; ``hours`` has the rows of those that have any."""

    def below(parents: str, members: list[tuple[str, list[int]]], level: int) -> Iterator[tuple[int, str]]:
        found = runs([sum(hours[h] for h in own) for _, own in members], limit)
        for i, (name, own) in enumerate(members):
            if (run := found[i]) or level == 2:
                first, last = run or (i, i)
                yield from ((h, f"{parents}{members[first][0]}-{members[last][0]}") for h in own)
            else:
                yield from below(f"{parents}{name}/", divided(int(parents.split("/")[1] if level else name), own, level + 1), level + 1)

    def divided(month: int, own: list[int], level: int) -> list[tuple[str, list[int]]]:
        first, n, name = ((1, 12, "month"), (1, monthrange(year, month)[1], "day"), (0, 24, "hour"))[level]
        parts: dict[int, list[int]] = {}
        for h in own:
            parts.setdefault(getattr(EPOCH + timedelta(hours=h), name), []).append(h)
        return [(f"{i:02d}", parts.get(i, [])) for i in range(first, first + n)]

    return dict(below(f"{year:04d}/", divided(1, sorted(hours), 0), 0))


def plan(histogram: DataFrame, limit: int) -> DataFrame:
    """(hour, leaf) from the rows of each hour, (year, hour, n); the hour NO_HOUR has no year."""

    def of_year(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        leaves = year_plan(key[0], dict(zip(part["hour"].tolist(), part["n"].tolist())), limit)
        return pd.DataFrame({"year": key[0], "hour": list(leaves), "leaf": list(leaves.values())})

    def of_years(part: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(part["year"].tolist(), part["n"].tolist()))
        years = list(range(min(n), max(n) + 1))
        found = zip(years, runs([n.get(y, 0) for y in years], limit))
        rows = [(y, f"{years[r[0]]:04d}-{years[r[1]]:04d}" if r else None) for y, r in found if y in n]
        return pd.DataFrame(rows, columns=["year", "whole"])

    timed = histogram.filter(F.col("hour") != NO_HOUR)
    inside = timed.groupBy("year").applyInPandas(of_year, "year int, hour long, leaf string")
    folded = timed.groupBy("year").agg(F.sum("n").alias("n")).groupBy().applyInPandas(of_years, "year int, whole string")
    leaves = inside.join(folded, "year").select("hour", F.coalesce("whole", "leaf").alias("leaf"))
    return leaves.unionByName(histogram.filter(F.col("hour") == NO_HOUR).select("hour", F.lit("null").alias("leaf")))


def hour_of(moment: Column) -> Column:
    """Hours since 1970 of a moment without a zone."""
    return F.coalesce(F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(moment), F.lit(NO_HOUR))


def parted(rows: DataFrame, moment: Column, order: list[str], limit: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with their LEAF and PART and the keys of a part's order, and these keys."""
    spark, n, given = rows.sparkSession, partitions(rows.sparkSession), rows.columns
    at, hour = fresh(rows, "moment"), fresh(rows, "hour")
    keys = [at, *order, *(c for c in given if c not in order)]
    timed = rows.withColumn(at, moment.cast("timestamp_ntz")).withColumn(hour, hour_of(col(at)))
    histogram = stored(timed.groupBy(F.year(col(at)).alias("year"), col(hour).alias("hour")).agg(F.count("*").alias("n")), "time-hours")
    leaves = plan(histogram, limit).join(histogram.select("hour", "n"), "hour")
    leaves = stored(leaves.join(leaves.groupBy("leaf").agg((F.sum("n") > limit).alias("big")), "leaf").select(F.col("hour").alias(hour), F.translate("leaf", "/", ".").alias(LEAF), "big"), "time-plan")
    named = timed.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_HOURS else leaves, hour)
    kept = [*map(col, given), col(at), F.col(LEAF)]
    small = named.filter(~F.col("big")).select(*kept, F.lit(1).alias(PART))
    big = named.filter("big").select(*kept)
    big = stored(big.repartitionByRange(n, LEAF, col(at), *map(col, order)).sortWithinPartitions(LEAF, *map(col, keys)), "time-order")
    big = big.select(*kept, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    starts = big.groupBy(LEAF, "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(LEAF).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(LEAF, "_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    big = big.join(starts, [LEAF, "_file"]).select(*kept, (F.call_function("div", F.col("_row") + F.col("_shift"), F.lit(limit)) + 1).cast("int").alias(PART))
    return small.unionByName(big), keys


def sums(files: DataFrame, columns: list[str]) -> DataFrame:
    """(LEAF, PART, n, h1, h2): the rows of each part, and what tells them from others."""
    each = [x for c in columns for x in (col(c), col(c).isNull())]
    hashes = [F.sum(F.xxhash64(F.lit(i), *each).cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    return files.groupBy(LEAF, PART).agg(F.count("*").alias("n"), *hashes)


def _with_folders(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(LEAF, T.StringType()), T.StructField(PART, T.IntegerType())])


def rewrite(rows: DataFrame, folder: str, moment: Column, order: list[str], limit: int, standing: bool = True) -> DataFrame:
    """Make ``folder`` hold ``rows`` in their layout; returns (LEAF, PART, rewritten) for each of its files.

    Parts that stand there already with the same rows are left alone. ``standing``
    is false for a folder that does not exist yet.
    """
    spark = rows.sparkSession
    parts, keys = parted(rows, moment, order, limit)
    if standing:
        there = stored(sums(spark.read.schema(_with_folders(rows.schema)).parquet(folder), rows.columns), "time-there")
        same = there.withColumn("same", F.lit(True))
        files = stored(sums(parts, rows.columns).join(same, [LEAF, PART, "n", "h1", "h2"], "left").select(LEAF, PART, F.col("same").isNull().alias("rewritten")), "time-files")
        changed = files.filter("rewritten").select(LEAF, PART)
        parts = parts.join(F.broadcast(changed) if changed.count() <= BROADCAST_FILES else changed, [LEAF, PART], "left_semi")
    dealt = parts.repartition(partitions(spark), LEAF, PART).sortWithinPartitions(LEAF, PART, *map(col, keys))
    dealt.select(*map(col, rows.columns), LEAF, PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LEAF, PART).parquet(folder)
    if not standing:
        return spark.read.schema(_with_folders(rows.schema)).parquet(folder).select(LEAF, PART, F.lit(True).alias("rewritten")).distinct()
    for gone in there.join(files, [LEAF, PART], "left_anti").select(LEAF, PART).toLocalIterator():
        drop_path(spark, f"{folder}/{LEAF}={gone[0]}/{PART}={gone[1]}")
    return files


def files_of(spark: SparkSession, folder: str, schema: T.StructType, key: str, new: Column) -> DataFrame:
    """(LEAF, PART, path, n_rows, n_new, ids_sha256) of each file, read back: the digest of its keys in file order."""
    files = spark.read.schema(_with_folders(schema)).parquet(folder)
    told = files.groupBy(LEAF, PART, F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"), F.count_if(new).alias("n_new"))
    narrow = files.select(LEAF, PART, F.col("_metadata.row_index").alias("row"), col(key).cast("string").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int32()), pa.array([digest.hexdigest()])], ["leaf", "part", "sha"])

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ids = [x or "" for x in batch.column(2).to_pylist()]
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if names[lo] != at:
                        yield from done()
                        at, digest = names[lo], sha256()
                    else:
                        digest.update(b",")
                    digest.update(",".join(ids[lo:hi]).encode())
        yield from done()

    dealt = narrow.repartition(partitions(spark), LEAF, PART).sortWithinPartitions(LEAF, PART, "row").select(LEAF, PART, "key")
    digests = mapped(dealt, run, f"{LEAF} string, {PART} int, ids_sha256 string")
    return told.join(digests, [LEAF, PART])


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: leaf, part, columns, ids_sha256, path, n_rows, n_new, rewritten for each file of the last layout."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    limit, folder = 1 + clicks.count() // 800, scratch_path(spark, "clicks")
    ts, k = F.col("ts").cast("timestamp_ntz"), F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    back = ts - F.make_dt_interval(((k + 6) * (k + 6) * (k + 6)).cast("int"))
    monday = F.date_sub(ts.cast("date"), F.weekday(ts.cast("date"))).cast("timestamp_ntz")
    moment = F.when(k < 16, back).when(k > 111, monday).otherwise(ts)
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"), F.lit(False))
    rewrite(clicks.filter(early), folder, moment, ["arrived_at", "click_id"], limit, standing=False)
    files = rewrite(clicks, folder, moment, ["arrived_at", "click_id"], limit)
    told = files_of(spark, folder, clicks.schema, "click_id", ~early).join(files, [LEAF, PART])
    return told.select(F.translate(LEAF, ".", "/").alias("leaf"), F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", F.col(PART).cast("long").alias("part"), "n_rows", "n_new", "rewritten")
