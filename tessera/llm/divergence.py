"""How far the sources of a language are from each other, term by term.

Terms are counted by (language, source) in the tasks, with a dictionary of
bounded size, before anything is shuffled. Each kept term of a language is a
sparse vector of its counts by source; terms with the same vector are one row
with a multiplicity, every pair of sources is evaluated once for each of these
rows, and the outcome is multiplied. The ranks of terms are those of the
original terms.

Pairs are summed up inside tasks: sources are cut into blocks of ``BLOCK``, and
a task that works off the vectors of two blocks holds one matrix of their pairs.
It adds f(p, q) - f(p0, q0), p0 and q0 being the shares of a term that the
sources do not have, so that vectors without either block need not be there; V
times f(p0, q0) is added at the end. All numbers are integers, products beyond
64 bits are decimals.

A vector is as long as a language has sources, the square of which the result
has rows; nothing else is gathered by language or source.

Defined results: a null text, language or source is the empty one; a language
without kept terms has pairs of value 0 and no terms; repeated rows are
documents of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, mapped, partitions, stored

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Sources in a block, vectors evaluated at once, terms that a task counts before it sends them on, characters that are cut into terms at once.
BLOCK, AT_ONCE, HELD, SLICE = 256, 256, 200_000, 1 << 20
#: So many (language, source) groups are broadcast at most.
BROADCAST_GROUPS = 100_000

#: A term is a run of ASCII letters and bytes above them; A-Z become a-z, any other byte a blank.
_BYTES = bytes(b | 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about ``SLICE`` bytes."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and _BYTES[text[end]] != 32:  # up to the end of a term
            end += 1
        yield text[at:end].translate(_BYTES).split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a null term for each group that occurs."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, d) in groups.items():
                rows = [None, *n]
                one = [pa.array([x] * len(rows), pa.binary()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*one, pa.array(rows, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], names)
            groups.clear()

        for batch in batches:
            for t, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, d = groups.setdefault((a, b), (Counter(), Counter()))
                own: set[bytes] = set()
                for part in terms(t):
                    n.update(part)
                    own.update(part)
                d.update(own)
                if sum(len(n) for n, _ in groups.values()) > HELD:
                    yield from sent()
        yield from sent()

    plain = docs.select(*(F.coalesce(col(c).cast("string"), F.lit("")).cast("binary").alias(c2) for c, c2 in ((text, "text"), (lang, "lang"), (source, "source"))))
    counted = mapped(plain, run, "lang binary, source binary, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counted.select(*(F.col(c).cast("string").alias(c) for c in names[:3]), "n", "docs")


def share(count: Column, total: Column, v: Column) -> Column:
    """p = 1 + floor(SCALE * (count + 2) / (total + 2 v)), exactly; null if there are no kept terms."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.when(v > 0, F.call_function("div", wide, (total + 2 * v).cast("decimal(20,0)")) + 1)


def distance(p: Column, q: Column) -> Column:
    """f = floor((p - q) ^ 2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_table(counts: DataFrame, kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, sid, total, v, lang_total, p0): each group, numbered within its language."""
    langs = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    out = counts.filter(F.col("term").isNull()).select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    out = out.na.fill(0, ["total", "v", "lang_total"]).withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return out.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v")))


def term_ranks(entries: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms by which a group is above its language, the first ``top``."""
    above = entries.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pair_sums(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, more) for a < b, from rows in the order of (lang, bi, bj, salt): first both blocks' p0, then vectors."""
    key, p0, acc = None, None, None

    def matrix(lists: pa.Array, base: np.ndarray, first: int) -> np.ndarray:
        out, flat = np.repeat(base[None, :], len(lists), axis=0), lists.flatten()
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        out[rows, flat.field("sid").to_numpy(zero_copy_only=False) - first] = flat.field("p").to_numpy(zero_copy_only=False)
        return out

    def done() -> Iterator[pa.RecordBatch]:
        if key is not None:
            a, b = np.nonzero(acc)
            more, a, b = acc[a, b], a + key[1] * block, b + key[2] * block
            own = a < b
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * int(own.sum()), pa.string()), pa.array(a[own]), pa.array(b[own]), pa.array(more[own])], ["lang", "a", "b", "more"])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if keys[lo] != key:
                yield from done()
                key, head = keys[lo], batch.slice(lo, 1)
                p0 = [head.column(c).flatten().field("p").to_numpy(zero_copy_only=False).astype(np.int64) for c in (5, 6)]
                acc = np.zeros((len(p0[0]), len(p0[1])), np.int64)
                zero = (p0[0][:, None] - p0[1]) ** 2 // (p0[0][:, None] + p0[1])
                lo += 1
            for at in range(lo, hi, AT_ONCE):
                part = batch.slice(at, min(AT_ONCE, hi - at))
                mult = part.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
                p, q = (matrix(part.column(5 + i), p0[i], key[1 + i] * block) for i in (0, 1))
                for i in range(p.shape[1]):
                    mine = p[:, i, None]
                    acc[i] += mult @ ((mine - q) ** 2 // (mine + q) - zero[i])
    yield from done()


def pair_values(entries: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the sum of f over its kept terms, both ways."""
    spark, n = groups.sparkSession, partitions(groups.sparkSession)
    vectors = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "n", "p"))).alias("vector"))
    vectors = vectors.groupBy("lang", "vector").agg(F.count("*").alias("mult"))
    blocks = groups.filter("v > 0").groupBy("lang", F.expr(f"int(sid div {block})").alias("block")).agg(F.sort_array(F.collect_list(F.struct("sid", F.col("p0").alias("p")))).alias("p0"))
    # Each vector goes to every two blocks of which it has one at least.
    within = vectors.join(blocks.groupBy("lang").agg(F.count("*").cast("int").alias("nb")), "lang")
    touched = F.array_distinct(F.transform("vector", lambda x: F.call_function("div", x["sid"], F.lit(block)).cast("int")))
    both = F.flatten(F.transform(touched, lambda i: F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(i, j).alias("bi"), F.greatest(i, j).alias("bj")))))
    within = within.select("lang", "vector", "mult", F.inline(F.array_distinct(both)))
    of = lambda b: F.transform(F.filter("vector", lambda x: F.call_function("div", x["sid"], F.lit(block)) == F.col(b)), lambda x: F.struct(x["sid"].alias("sid"), x["p"].alias("p")))
    rows = within.select("lang", "bi", "bj", F.pmod(F.xxhash64("vector"), F.lit(n)).cast("int").alias("salt"), "mult", of("bi").alias("x"), of("bj").alias("y"))
    heads = blocks.select("lang", F.col("block").alias("bi"), F.col("p0").alias("x")).join(blocks.select("lang", F.col("block").alias("bj"), F.col("p0").alias("y")), "lang").filter("bi <= bj")
    heads = heads.select("lang", "bi", "bj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"), F.lit(0).cast("long").alias("mult"), "x", "y")
    dealt = heads.unionByName(rows).repartition(n, "lang", "bi", "bj", "salt").sortWithinPartitions("lang", "bi", "bj", "salt", "mult")
    sums = mapped(dealt, lambda batches: _pair_sums(batches, block), "lang string, a long, b long, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))

    one = [groups.select("lang", F.col("sid").cast("long").alias(x), F.col("source").alias(f"source_{x}"), F.col("p0").alias(f"p0_{x}"), *(["v"] if x == "a" else [])) for x in "ab"]
    pairs = one[0].join(one[1], "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * distance(F.col("p0_a"), F.col("p0_b")) + F.coalesce("more", F.lit(0))).otherwise(0)
    ways = F.array(*(F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")))
    return pairs.select("lang", value.alias("value"), F.inline(ways)).select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of each source by distance, and the terms it has more often than its language."""
    counts = stored(term_counts(docs, text, lang, source), "audit-counts")
    totals = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = stored(counts.join(totals, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "audit-kept")
    groups = stored(group_table(counts, kept, kept.select("lang", "term", "all").distinct()), "audit-groups")
    small = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda x: x)
    entries = kept.join(small(groups), ["lang", "source"])
    entries = stored(entries.select("lang", "source", "sid", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("v")).alias("q")), "audit-entries")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(entries, groups, block).withColumn("rank", F.row_number().over(order))
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for name, x in (("pair", pairs), ("term", term_ranks(entries, top)))]
    return parts[0].unionByName(parts[1])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: lang, source, part, item, value, rank."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total, l.v, l.total AS lang_total
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON g.lang = l.lang LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
met AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
