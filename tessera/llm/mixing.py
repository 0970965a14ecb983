"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; cumulative sums over at most 4096
buckets a source find the bucket in which a source's budget ends; only that
bucket is split by the next bits of the hash. The outcome is one threshold a
source, so that choosing documents is a filter and nothing is sorted. Thresholds
are nested: a larger budget keeps every document that a smaller one took.

Defined results: a null text counts 0 words; a document without an id has the
hash of its text in place of the id's; documents without a source form one
source, the last; repeated rows are documents of their own and share their
fate; an empty table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, fresh, hash60, n_words, stored, text_or_empty

#: Hash bits that one histogram resolves, and how many histograms are nested.
BITS, LEVELS, HASH_BITS = 12, 4, 60
#: So many sources are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Rows that come to the driver from one histogram of sources.
BUCKETS = 4096


def hash_of(doc_id: Column, text: Column) -> Column:
    """The hash of a document: that of its id, or of its text if it has no id."""
    return hash60(F.coalesce(doc_id.cast("string"), F.concat(F.lit("\0"), F.sha2(text.cast("binary"), 256))))


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h): the words of each document and its hash."""
    return docs.select(
        col(doc_id).alias("doc_id"), col(source).alias("source"),
        n_words(text_or_empty(text)).alias("size"), hash_of(col(doc_id), text_or_empty(text)).alias("h"),
    )


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target): water-filling of ``share`` of all words.

    Sources by code point, null last, have the weights in turn. No target is
    above ``most`` times its source; the excess goes to the others by weight.
    Sources may be as many as hosts: they are numbered by sorted ranges, and the
    level is found by histograms, so no task sees all of them.
    """
    order = F.col("source").asc_nulls_last()
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stored(by_source.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row a partition
    before = before.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights)).cast("int") + 1)
    t = ranged.join(F.broadcast(before), "range").withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    t = stored(t.select("source", "source_size", "w", "most"), "mix-weights")
    level = _level(t, share)
    return t.select("source", "source_size", F.least(F.lit(level).cast("double") * F.col("w"), "most").alias("target"))


def _level(t: DataFrame, share: float) -> float | None:
    """The level at which sources (source_size, w, most), each taking level * w but ``most`` at the utmost, take ``share`` of all words; None if all take the utmost.

    Sources become full in the order of most / w. The bucket of this order that
    holds the level is divided until it has few different places; a bucket's
    sums are what comes to the driver.
    """
    t = t.withColumn("full", F.col("most") / F.col("w"))
    total, end, n = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.max("full"), F.count_distinct("full")).first()
    goal, lo, full, open_w = total * float(share), 0.0, 0.0, 0.0  # the words of full sources below the bucket, the weights above it
    hi = math.nextafter(end or 0.0, math.inf)

    def sums(key: Column) -> list:
        return t.filter((F.col("full") >= lo) & (F.col("full") < hi)).groupBy(key.alias("k")).agg(F.sum("most").alias("most"), F.sum("w").alias("w"), F.count_distinct("full").alias("n")).orderBy("k").collect()

    while n > BUCKETS and (width := (hi - lo) / BUCKETS) > 1e-9:
        rows = sums(F.least(F.floor((F.col("full") - F.lit(lo)) / F.lit(width)), F.lit(BUCKETS - 1)))
        rest = sum(r.w for r in rows)
        for r in rows:
            rest -= r.w
            top = hi if r.k == BUCKETS - 1 else lo + (r.k + 1) * width
            if full + r.most + top * (rest + open_w) >= goal or r is rows[-1]:
                break
            full += r.most
        n, open_w = r.n, open_w + rest
        # A margin on either side, as edges are rounded; what is in it belongs to the bucket.
        lo, hi = max(lo, lo + r.k * width - width / 64), min(hi, top + width / 64)
        full, open_w = t.agg(*(F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0)) for c, x in ((F.col("full") < lo, "most"), (F.col("full") >= hi, "w")))).first()
    rows = sums(F.col("full"))
    rest = open_w + sum(r.w for r in rows)
    for r in rows:
        if (goal - full) / rest <= r.k:
            return (goal - full) / rest
        full, rest = full + r.most, rest - r.w
    return (goal - full) / rest if rest > 0 else None


def plan(sizes: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, base, threshold) by source.

    A document is taken ``base`` times, and once more if its hash is below the
    threshold. ``sizes`` is what :func:`sized` returns, stored, as it is read
    once for each level; what is gathered is 4096 sums a source.
    """
    goals = targets(sizes, list(weights), share, most).withColumns({
        "base": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long"),
    })
    goals = stored(goals.withColumns({"rest": F.col("target") - F.col("base") * F.col("source_size"), "low": F.lit(0).cast("long")}), "mix-targets")
    few = goals.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda x: x)
    open_ = goals.filter(F.col("rest") > 0)
    for level in range(1, LEVELS + 1):
        width = HASH_BITS - BITS * level
        edge = open_.select(F.col("source").alias("edge"), "low")
        inside = sizes.join(small(edge), F.col("source").eqNullSafe(F.col("edge")) & (F.shiftright("h", width + BITS) == F.shiftright("low", width + BITS)))
        hist = inside.groupBy("source", F.shiftright("h", width).alias("bucket")).agg(F.sum("size").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumns({"above": up_to}).withColumnRenamed("source", "edge")
        at = hist.join(small(open_.select("source", "rest")), F.col("source").eqNullSafe(F.col("edge"))).filter((F.col("above") > F.col("rest")) & (F.col("above") - F.col("n") <= F.col("rest")))
        open_ = stored(
            at.groupBy("source").agg(F.min(F.struct("bucket", "n", "above", "rest")).alias("b"))
            .select("source", F.shiftleft("b.bucket", width).alias("low"), (F.col("b.rest") - (F.col("b.above") - F.col("b.n"))).alias("rest"), F.col("b.n").alias("n"), F.lit(1 << width).cast("long").alias("width")),
            "mix-edge",
        )
    # The last bucket is one document or a few with equal bits: taken if that comes nearer to the target.
    ends = open_.select(F.col("source").alias("edge"), (F.col("low") + F.when(F.col("rest") * 2 > F.col("n"), F.col("width")).otherwise(F.lit(0))).alias("threshold"))
    return goals.drop("rest", "low").join(small(ends), F.col("source").eqNullSafe(F.col("edge")), "left").select(
        "source", "source_size", "target", "base", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"),
    )


def with_plan(df: DataFrame, source: str, the_plan: DataFrame) -> DataFrame:
    """``df`` with the plan's columns as a struct ``mix`` (a name that is free)."""
    mix, key = fresh(df, "mix"), fresh(df, "mix_source")
    side = the_plan.select(F.col("source").alias(key), F.struct("source_size", "target", "base", "threshold").alias(mix))
    side = F.broadcast(side) if the_plan.count() <= BROADCAST_SOURCES else side
    return df.join(side, col(source).eqNullSafe(col(key))).drop(key)


def copies(doc_id: Column, text: Column, mix: Column) -> Column:
    """How often the mix takes a document."""
    return mix["base"] + (hash_of(doc_id, text) < mix["threshold"]).cast("long")


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mix, with the columns they had; one row for each time that a document is taken."""
    got = stored(plan(stored(sized(docs, text, source, doc_id), "mix-sizes"), weights, share, most), "mix-plan")
    name = fresh(docs, "mix")
    out = with_plan(docs, source, got)
    times, n = fresh(out, "times"), copies(col(doc_id), text_or_empty(text), col(name)).cast("int")
    return out.filter(n > 0).withColumn(times, F.explode(F.array_repeat(F.lit(1), n))).drop(name, times)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, source_size, target, taken for each document."""
    sizes = stored(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    got = stored(plan(sizes), "mix-plan")
    taken = F.col("mix.base") + (F.col("h") < F.col("mix.threshold")).cast("long")
    return with_plan(sizes, "source", got).select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (taken * F.col("size")).alias("taken"))


SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM by_source),
w AS (SELECT *, CAST(CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS most FROM turns),
l AS (SELECT *, ((SELECT sum(source_size) FROM by_source) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
goal AS (SELECT source, turn, source_size, least((SELECT arg_min(level, (most / w, turn)) FROM l WHERE level <= most / w) * w, most) AS target FROM l),
base AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS base FROM goal),
upto AS (SELECT b.turn, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY b.turn ORDER BY h) AS above, any_value(target - base * source_size) AS rest
    FROM s JOIN base b ON s.source IS NOT DISTINCT FROM b.source GROUP BY b.turn, h),
cut AS (SELECT turn, max(h) AS last_h FROM upto WHERE above <= rest OR (above - n <= rest AND (rest - (above - n)) * 2 > n) GROUP BY turn)
SELECT s.doc_id, s.size, b.source_size, CAST(b.target AS DOUBLE) AS target,
    CAST(s.size * (b.base + CASE WHEN s.h <= c.last_h THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN base b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN cut c ON b.turn = c.turn
"""
