"""Structured Streaming: running hexagon counts, windows over event time, online models by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.binning import HEX, hexed


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of the files of a folder, or of one file by its name."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return reader.option("pathGlobFilter", name).load(folder) if "." in name else reader.load(path)


def hex_counts(pixels: DataFrame, width: float = 24.0, n_move: int = 1, key: str = "Count") -> DataFrame:
    """Running counts by cell, for update or complete mode."""
    return hexed(pixels, width, n_move).groupBy(*HEX).agg(F.sum(key).alias("tot"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by window of event time; rows later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: tuple[str, ...] = ("user_id",), ts: str = "ts") -> DataFrame:
    """Counts by session: events closer than the gap belong together."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The state after all available input, by way of a memory table: for results of bounded size and for tests."""
    name = f"drained_{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Run a function on each micro-batch until the input is used up; with a checkpoint it resumes where it stopped."""
    writer = stream.writeStream.foreachBatch(do).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def _batches(spark: SparkSession, folder: str, mark: str) -> list[int]:
    """The numbers of the folders ``batch=i`` that hold the file ``mark``, which is written last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/{mark}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(str(f.getPath().toString()).split("batch=")[-1].split("/")[0]) for f in found)


def online_model(stream: DataFrame, model, prepare: Callable[[DataFrame], DataFrame], total: float, checkpoint: str | None = None):
    """Update a model with each micro-batch of units that ``prepare`` makes of it.

    With a checkpoint the model is saved under its batch's number, beside the
    stream's own state. A batch begins with the model of the batch before it, so
    that a run that stopped anywhere, in the middle of a batch too, goes on to
    the result of a run that did not.
    """
    spark, folder = stream.sparkSession, f"{checkpoint}/models" if checkpoint else ""

    def load(before: int) -> None:
        known = [i for i in _batches(spark, folder, "meta/_SUCCESS") if i < before]
        if known:
            model.__dict__.update(type(model).load(spark, f"{folder}/batch={known[-1]}").__dict__)

    def step(batch: DataFrame, i: int) -> None:
        if folder:
            load(i)
        units = prepare(batch)
        if not units.isEmpty():
            model.update(units, total)
        if folder:
            model.save(spark, f"{folder}/batch={i}")

    each_batch(stream, step, checkpoint).awaitTermination()
    if folder:
        load(1 << 62)
    return model


def keep_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running totals by cell (:func:`hex_counts`), whose state is in the state store: each micro-batch adds those that it changed.

    A batch that runs again writes over itself; :func:`totals` gives the last of each cell.
    """

    def step(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={i}")

    return totals.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, keys: tuple[str, ...] = tuple(HEX), value: str = "tot") -> DataFrame:
    """The last total of each cell that :func:`keep_totals` wrote."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def merged_totals(spark: SparkSession, path: str, to: str, keys: tuple[str, ...] = tuple(HEX), value: str = "tot") -> DataFrame:
    """The totals as one table at ``to``, in place of as many as there were batches."""
    totals(spark, path, keys, value).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def write_hex_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Partial counts by cell of each micro-batch, appended; a later sum by cell gives the totals. Replayed batches overwrite themselves."""

    def step(batch: DataFrame, i: int) -> None:
        batch.groupBy(*HEX).agg(F.sum("Count").alias("tot")).write.mode("overwrite").parquet(f"{path}/batch={i}")

    return each_batch(stream, step, checkpoint)
