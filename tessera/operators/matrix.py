"""Unit by gene matrices: feature index, packed units, log normalisation, train and test parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import kept_features, train_test


def features(counts: DataFrame, min_ct: float = 50, listed: DataFrame | None = None, white: DataFrame | None = None, forced: bool = False) -> DataFrame:
    """(gene, idx, total, weight): features in the order of their names.

    With a list, its members (with ``forced`` those without enough counts too);
    else all with enough counts or on the white list. The index is a row number
    over distinct features, of which there are some tens of thousands.
    """
    if listed is None:
        out = kept_features(counts, min_ct, white, "n")
    else:
        out = listed.select("gene").distinct().join(counts.groupBy("gene").agg(F.sum("n").alias("total")), "gene", "left").fillna(0, ["total"])
        out = out if forced else out.filter(F.col("total") >= min_ct)
    out = out.withColumn("idx", F.row_number().over(Window.orderBy("gene")) - 1)
    return out.withColumn("weight", F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1)))).select("gene", "idx", "total", "weight")


def units(counts: DataFrame, index: DataFrame, min_ct: float = 50) -> DataFrame:
    """(unit, idx array, cnt array, tot): units with at least ``min_ct`` of the indexed features, duplicates summed."""
    known = counts.filter("n > 0").join(F.broadcast(index.select("gene", "idx")), "gene").groupBy("unit", "idx").agg(F.sum("n").cast("double").alias("n"))
    packed = known.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("v"), F.sum("n").alias("tot")).filter(F.col("tot") >= min_ct)
    return packed.select("unit", F.col("v.idx").alias("idx"), F.col("v.n").alias("cnt"), "tot")


#: In UTF-8, all bytes but those of lower-case letters as blanks.
LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
#: Texts that are taken apart at once.
TEXTS = 2048


def _words(texts: DataFrame, run: Callable[[pa.RecordBatch, pa.ListArray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``run`` makes of some rows (unit, text) and the words of each: runs of a to z in lower case, and empty ones at blank ends."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, TEXTS) for x in batches for a in range(0, x.num_rows, TEXTS)):
            spaced = pa.array([x.translate(LETTERS) for x in b.column("text").to_pylist()], pa.binary()).cast(pa.string())
            yield run(b, pc.ascii_split_whitespace(spaced))

    return texts.filter("text IS NOT NULL").select("unit", F.lower("text").cast("binary").alias("text")).mapInArrow(split, schema)


def word_totals(texts: DataFrame) -> DataFrame:
    """(gene, n): counts of the words of texts (unit, text), counted in tasks: a word has one row or more from each."""

    def run(_: pa.RecordBatch, words: pa.ListArray) -> pa.RecordBatch:
        counted = pc.value_counts(words.flatten())
        return pa.record_batch([counted.field("values"), counted.field("counts")], ["gene", "n"])

    return _words(texts, run, "gene string, n long").filter("gene <> ''")


def _packed(of: pa.DictionaryArray, key: np.ndarray, n: np.ndarray, m: int) -> pa.RecordBatch:
    """A row for each unit: n by key, which is the unit's place in the dictionary times m and the gene's index, rising."""
    at = key // m
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(of.dictionary)))]).astype(np.int32)
    idx, cnt = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key % m).astype(np.int32), n.astype(float)))
    return pa.record_batch([of.dictionary, idx, cnt, pa.array(np.bincount(at, n, len(of.dictionary)).astype(float))], ["unit", "idx", "cnt", "tot"])


def word_units(texts: DataFrame, genes: list, min_ct: float = 50) -> DataFrame:
    """(unit, idx array, cnt array, tot) as of :func:`units`, from texts (unit, text) and the words in the order of their index.

    A text's words are counted in its task; what is shuffled is one row of arrays
    a text, and texts of one unit are added up on the way, before and after.
    """
    m = max(len(genes), 1)

    def pack(b: pa.RecordBatch, words: pa.ListArray) -> pa.RecordBatch:
        of = b.column("unit").dictionary_encode("encode")
        idx = pc.index_in(words.flatten(), pa.array(genes, pa.string())).fill_null(-1).to_numpy()
        key = np.repeat(of.indices.to_numpy().astype(np.int64), words.value_lengths().to_numpy()) * m + idx
        return _packed(of, *np.unique(key[idx >= 0], return_counts=True), m)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # whose unit may go on
        for b in batches:
            columns = [b.column("unit"), b.column("idx").cast(pa.list_(pa.int32())), b.column("cnt").cast(pa.list_(pa.float64())), b.column("tot")]
            b = pa.record_batch(columns if last is None else [pa.concat_arrays(x) for x in zip(last.columns, columns)], b.schema.names)
            of = b.column("unit").dictionary_encode("encode")
            if len(of.dictionary) < len(of):
                key = np.repeat(of.indices.to_numpy().astype(np.int64), b.column("idx").value_lengths().to_numpy()) * m + b.column("idx").flatten().to_numpy()
                key, entry = np.unique(key, return_inverse=True)
                b = _packed(of, key, np.bincount(entry, b.column("cnt").flatten().to_numpy(), len(key)), m)
            last = b.slice(b.num_rows - 1)
            yield b.slice(0, b.num_rows - 1)
        if last is not None:
            yield last

    schema = f"unit {texts.schema['unit'].dataType.simpleString()}, idx array<int>, cnt array<double>, tot double"
    return _words(texts, pack, schema).filter("tot > 0").repartition("unit").sortWithinPartitions("unit").mapInArrow(merge, schema).filter(F.col("tot") >= min_ct)


#: Sums that come to the driver from one histogram.
BUCKETS = 4096


def at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """The value of a column that has ``rank`` others before it: histograms, each of the bucket of the last one that holds the rank.

    A bucket goes on between its least and greatest values, so that it ends with
    one value however they lie; what comes to the driver is a bucket's counts.
    """
    c = F.col(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    while low is not None and low < high:
        wide = (high / BUCKETS) - (low / BUCKETS)
        place = F.least(F.floor((c - F.lit(low)) / F.lit(wide)), F.lit(BUCKETS - 1)) if wide > 0 else (c > F.lit(low)).cast("long")
        rows = df.filter(c.between(low, high)).groupBy(place.alias("k")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy("k").collect()
        for r in rows:
            if rank < r.n or r is rows[-1]:
                break
            rank -= r.n
        low, high = r.lo, r.hi
    return low


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact quantile of a column's values that are not null, linear between the two ranks around it."""
    known = df.filter(F.col(column).isNotNull())
    n = known.count()
    if not n:
        return None
    at = q * (n - 1)
    low = at_rank(known, column, int(at))
    return low if at == int(at) else low + (at_rank(known, column, int(at) + 1) - low) * (at - int(at))


def log_normalised(counts: DataFrame, size_factor: bool = False, q: float = 0.95, scale: float = 0.0) -> DataFrame:
    """(unit, gene, x): logarithms of scaled counts.

    Counts are divided by their unit's sum, or with ``size_factor`` by that sum
    over the mean sum; the first are divided by the same logarithm of one count
    in a unit of the quantile ``q``, or by ``scale`` if it is given.
    """
    sums = counts.groupBy("unit").agg(F.sum("n").cast("double").alias("s"))
    both = counts.join(sums, "unit")
    held = sums.select("s").persist()  # one number a unit
    mean = held.agg(F.avg("s")).first()[0]
    high = None if mean is None or size_factor or scale > 0 else quantile(held, "s", q)
    held.unpersist()
    if mean is None:
        return both.select("unit", "gene", F.lit(0.0).alias("x"))
    if size_factor:
        x = F.log(F.col("n") / (F.col("s") / F.lit(mean)) + F.lit(1.0))
    else:
        x = F.log(F.col("n") / F.col("s") + F.lit(1.0)) / (F.lit(float(scale)) if scale > 0 else F.log(F.lit(1.0) / F.lit(high) + F.lit(1.0)))
    return both.select("unit", "gene", x.alias("x"))


def epochs(units: DataFrame, key: str = "unit", length: int = 2) -> DataFrame:
    """``units`` with the epoch, the first characters of an id: one epoch is one pass over the tissue."""
    return units.withColumn("epoch", F.substring(F.col(key), 1, length))


def parts(units: DataFrame, train: float, seed: int = 0, key: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(training, test) units by hash."""
    mine = train_test(F.col(key), train, seed)
    return units.filter(mine), units.filter(~mine)


def augmented(counts: DataFrame, buffer: DataFrame, strength: float) -> DataFrame:
    """(unit, gene, n, buffer_n, buffer_weight): focal and surrounding counts; the weight is b / (b + strength) by unit."""
    both = counts.select("unit", "gene", "n").join(buffer.select("unit", "gene", F.col("n").alias("buffer_n")), ["unit", "gene"], "full").fillna(0, ["n", "buffer_n"])
    b = F.sum("buffer_n").over(Window.partitionBy("unit"))
    return both.withColumn("buffer_weight", b / (b + F.lit(float(strength))))
