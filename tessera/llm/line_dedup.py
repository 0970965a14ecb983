"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

The store holds runs: tables bucketed and sorted by line hash. A new batch is
merge-joined with the runs once, bucket by bucket and without a shuffle of the
runs; lines that no run has are new, and become a run of their own at level 0.
So a line hash is in one run only. When a level has ``fan_in`` runs they are
merged into one run of the next level, again by buckets without a shuffle, which
keeps the number of runs at the logarithm of the number of batches. Lines that a
run has already are kept beside the batch's run. With all batches in, a line's
documents are its run's count and those of later batches.

Lines are keyed by two independent 64-bit hashes, with which no two lines of a
corpus of 100 TB are expected to collide.

Defined results: a null text is one empty line; a null doc_id sorts below all
others, and ids are whole numbers; repeated rows count as documents of their own and lose the same lines;
lines of one document count once; an empty table gives an empty result; other
columns stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WS_CHARS, ascii_lower, col, drop_path, fresh, indices, let, partitions, scratch_path, stored, text_or_empty

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FAN_IN = 4, 2
LEAST = -(1 << 63)


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Jobs within take the order of bucketed tables as it is; a part of a run has one file a bucket, which Spark checks."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, last_doc), on the shared folder.

    A batch is one table in two parts by ``known``: its new lines, which are a
    run, and the lines that a run has already.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.buckets = spark, fan_in, partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name, path = f"tessera_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        with _in_order(self.spark):
            df.write.partitionBy("known").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter(~F.col("known")).drop("known")

    def runs(self) -> list[DataFrame]:
        return [self._run(x) for level in self.levels for x in level]

    def again(self) -> list[DataFrame]:
        """The lines of each batch that a run had already, of merged runs too."""
        schema = "h1 long, h2 long, n_docs long, last_doc long, known boolean"
        return [self.spark.read.schema(schema).parquet(x).filter("known").drop("known") for x in self.paths.values()]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, n_docs, last_doc), one row a line hash.

        Returns the lines that no earlier batch had, as a table that stands until the next batch.
        """
        self._compact()
        marked = lines.repartition(self.buckets, "h1", "h2").withColumn("known", F.lit(False))
        for run in self.runs():
            marked = marked.join(run.select("h1", "h2", F.lit(True).alias("_seen")), ["h1", "h2"], "left").withColumn("known", F.col("known") | F.col("_seen").isNotNull()).drop("_seen")
        name = self._write(marked.select("h1", "h2", "n_docs", "last_doc", "known"))
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        return self._run(name)

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fan_in:
                old = self.levels[k]
                name = self._write(reduce(_merged, [self._run(x) for x in old]).withColumn("known", F.lit(False)))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k], _ = [], self.levels[k + 1].append(name)
                for x in old:  # what was known stays until the end
                    self.spark.sql(f"DROP TABLE IF EXISTS {x}")
                    drop_path(self.spark, f"{self.paths[x]}/known=false")
            k += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of the lines found in at least so many documents."""
        later = reduce(DataFrame.unionByName, self.again()).groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        both = [x.join(later, ["h1", "h2"], "left") for x in self.runs()]
        return reduce(DataFrame.unionByName, both).select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc")).filter(F.col("n_docs") >= min_docs)

    def close(self) -> None:
        """Delete the runs."""
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)
        self.levels, self.paths = [], {}


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: a merge bucket by bucket without a shuffle. A line is in one of them only."""
    both = a.join(b.select("h1", "h2", F.col("n_docs").alias("_n"), F.col("last_doc").alias("_d")), ["h1", "h2"], "full")
    return both.select("h1", "h2", F.coalesce("n_docs", "_n").alias("n_docs"), F.coalesce("last_doc", "_d").alias("last_doc"))


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, th, h1, h2, pos, first): each line of at least ``min_chars`` code points; first marks a line's first place in its document."""
    t = text_or_empty(text)

    def keyed(x: Column, i: Column) -> Column:
        key = F.btrim(x, F.lit(WS_CHARS))
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), i.cast("int").alias("pos")))

    ordered = F.array_sort(F.filter(F.transform(F.split(ascii_lower(t), "\n", -1), keyed), lambda x: x.isNotNull()))
    same = lambda x, y: F.coalesce((x["h1"] == y["h1"]) & (x["h2"] == y["h2"]), F.lit(False))
    marked = let(ordered, lambda o: F.transform(o, lambda x, j: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), (~same(x, F.get(o, j - 1))).alias("first"))))
    return docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LEAST)).alias("d"), F.xxhash64(t).alias("th"), F.inline(marked))


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """(d, th, gone): the places of the lines that a document loses, for documents that lose any."""
    spark = docs.sparkSession
    occ = stored(occurrences(docs, text, doc_id, min_chars).withColumn("batch", F.pmod(F.xxhash64("d"), F.lit(batches)).cast("int")), "line-occurrences", "batch")
    with closing(LineRuns(spark, fan_in)) as runs:
        for b in range(batches):
            runs.add(occ.filter(F.col("batch") == b).groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("d").alias("last_doc")))
        with _in_order(spark):
            frequent = stored(runs.frequent(min_docs).select("h1", "h2", "last_doc"), "line-frequent")
    hits = occ.join(frequent, ["h1", "h2"]).filter(F.col("d") < F.col("last_doc"))
    return hits.groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """``docs`` with a struct ``lines`` (a free name): n_lines, n_dropped, kept (the text without the dropped lines)."""
    name, d, th, gone = (fresh(docs, x) for x in ("lines", "lines_d", "lines_th", "lines_gone"))
    drops = dropped_lines(docs, text, doc_id, **limits).toDF(d, th, gone)
    t = text_or_empty(text)
    out = docs.join(drops, (F.coalesce(col(doc_id).cast("long"), F.lit(LEAST)) == col(d)) & (F.xxhash64(t) == col(th)), "left")
    lines = F.split(t, "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(indices(F.size(x)), col(gone)), lambda i: F.get(x, i)), "\n"))
    return out.withColumn(name, F.struct(
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(col(gone)), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(col(gone).isNull(), t).otherwise(left).alias("kept"),
    )).drop(d, th, gone)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """All documents, their texts without the dropped lines; a column n_chars follows the text."""
    name = fresh(docs, "lines")
    out = deduplicated(docs, text, doc_id, **limits)
    new = {text: F.when(col(name)["n_dropped"] > 0, col(name)["kept"]).otherwise(col(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(col(name)["n_dropped"] > 0, F.char_length(col(name)["kept"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*map(col, docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_lines, n_dropped, kept_sha256 for each document."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dropped").alias("n_dropped"), F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
m AS (SELECT l.r, l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id < f.last_doc AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
