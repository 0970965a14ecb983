"""Quality rules with cross-document line frequency, in SQL expressions only.

Base rules look at one document: too few words, or too many words inside
repeated three-word windows. The cross-document rule hashes normalised lines,
counts in how many distinct documents of a host each line occurs, removes the
lines above the limits, and rejects a document that is depleted by that. Exact
copies are one document in these counts, so a text that was merely copied is
left to deduplication and is not taken for a navigation line.

Only hashes are shuffled, summed before each shuffle; texts stay where they are.
The lines above the limits number at most (mean lines of a document) / share for
each host; they are broadcast if a count shows that they are few, else joined.

Defined results: a null text is empty and fails the base rules; a null host is
one host; repeated rows get equal verdicts; an empty table gives an empty
result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WS, WS_CHARS, ascii_lower, col, fresh, indices, let, stored, text_or_empty, words

MIN_WORDS, REPEAT_SHARE = 50, 0.5
#: A line goes if it is in at least so many distinct documents of the host, and in more than this share of them.
LINE_DOCS, LINE_SHARE = 5, 0.05
#: A document goes if less than this share of its words remains: a quarter of it was lines of the host.
LEFT_SHARE = 0.75
BROADCAST_HOSTS = 10_000
BROADCAST_LINES = 200_000


def repeat_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in the same array of words."""

    def of(w: Column) -> Column:
        first = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        windows = F.transform(first, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def covered(h: Column) -> Column:
            ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def hit(o: Column) -> Column:
                same = F.filter(o, lambda x, j: (x["h"] == F.get(o, j - 1)["h"]) | (x["h"] == F.get(o, j + 1)["h"]))
                return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

            # A neighbour outside the array is null: not equal.
            return let(ordered, hit)

        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(w, of)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text beside those of its words."""
    blank_free = F.translate(text, WS_CHARS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
    return {
        "word_chars": F.char_length(blank_free).cast("long"),
        "n_symbols": (F.char_length(blank_free) - F.char_length(F.translate(blank_free, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * int(100 * REPEAT_SHARE))


def line_key(line: Column) -> Column:
    """The hash of a normalised line: trimmed, A-Z in lower case; null for a line without a word."""
    key = ascii_lower(F.btrim(line, F.lit(WS_CHARS)))
    return F.when(key != "", F.xxhash64(key))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), line_key)


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, lines): the hashes of the lines above the limits, for each host that has any."""
    t = docs.select(col(host).alias("host"), text_or_empty(text).alias("t")).select(
        "host", F.xxhash64("t").alias("doc"), F.explode(F.array_union(F.array_distinct(line_keys(F.col("t"))), F.array(F.lit(None).cast("long")))).alias("line"),
    )
    # The null line, which every document has once, counts the host's documents.
    n = t.groupBy("host", "line").agg(F.count_distinct("doc").alias("n"))
    n = stored(n.filter((F.col("n") >= line_docs) | F.col("line").isNull()), "quality-lines")
    hosts = n.filter(F.col("line").isNull()).select(F.col("host").alias("host2"), F.col("n").alias("of"))
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    above = n.filter(F.col("line").isNotNull()).join(hosts, F.col("host").eqNullSafe(F.col("host2"))).filter(F.col("n") > F.col("of") * F.lit(line_share))
    return stored(above.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")), "quality-frequent")


def without_lines(text: Column, gone: Column) -> Column:
    """A text without the lines whose keys are in an array; null if it has none of them. Each line is hashed once."""
    lines = F.split(text, "\n", -1)

    def cut(keys: Column) -> Column:
        rest = lambda c: F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(c, F.get(keys, i)), F.lit(False)))
        return let(F.array_intersect(keys, gone), lambda c: F.when(F.size(c) > 0, F.array_join(rest(c), "\n")))

    return F.when(gone.isNotNull(), let(F.transform(lines, line_key), cut))


def judged(docs: DataFrame, text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE, measured: bool = True) -> DataFrame:
    """``docs`` with a struct ``quality`` (a free name): the measures (unless not ``measured``), ``kept``, ``left_text``, the text without frequent lines, and ``cut_text``, the same, null where nothing was removed.

    All is made once a row, in a generator, as a filter on ``kept`` below the
    projection would make it again.
    """
    frequent = frequent_lines(docs, text, host, line_docs, line_share)
    few = (frequent.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]) <= BROADCAST_LINES
    q, host2, lines, made = (fresh(docs, x) for x in ("quality", "quality_host", "quality_lines", "quality_made"))
    side = frequent.select(F.col("host").alias(host2), F.col("lines").alias(lines))
    out = docs.join(F.broadcast(side) if few else side, col(host).eqNullSafe(col(host2)), "left")
    t = text_or_empty(text)

    def verdict(w: Column, repeat: Column, left: Column) -> Column:
        failed, n = base_failed(F.size(w), repeat), F.size(w).cast("long")
        depleted = left.isNotNull() & (F.regexp_count(left, F.lit(f"[^{WS}]+")) < n * F.lit(left_share))
        return F.struct(n.alias("n_words"), repeat.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("cut_text"))

    judge = let(words(t), lambda w: let(repeat_words(w), lambda r: let(without_lines(t, col(lines)), lambda left: verdict(w, r, left))))
    others = F.struct(*(v.alias(k) for k, v in measures(t).items())) if measured else F.lit(None)
    out = out.select(*map(col, docs.columns), F.explode(F.array(F.struct(judge.alias("judge"), others.alias("others")))).alias(made))
    j, o = col(made)["judge"], col(made)["others"]
    fields = [j["n_words"], *([o["word_chars"], o["n_symbols"], o["n_dup_lines"]] if measured else []), j["n_repeat_words"], j["base_failed"], j["kept"], F.coalesce(j["cut_text"], t), j["cut_text"]]
    names = ["n_words", *(["word_chars", "n_symbols", "n_dup_lines"] if measured else []), "n_repeat_words", "base_failed", "kept", "left_text", "cut_text"]
    return out.withColumn(q, F.struct(*(f.alias(n) for f, n in zip(fields, names)))).drop(made)


def filter_quality(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that pass, without the lines above the limits; a column n_chars follows the text."""
    q = fresh(docs, "quality")
    out = judged(docs, text, host, measured=False, **limits).filter(col(q)["kept"])
    left = col(q)["cut_text"]
    new = {text: F.coalesce(left, col(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length(left).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.withColumns(new).select(*map(col, docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_words, the four measures, base_failed, kept for each document."""
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", *(F.col(f"quality.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
many AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM many) GROUP BY r),
m AS (SELECT r, doc_id, source, t, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST((SELECT count(x) - count(DISTINCT x) FROM (SELECT unnest(list_filter(lines, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) AS x)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
l AS (SELECT r, source, t, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, source, t, unnest(lines) AS x FROM w)),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
freq AS (SELECT a.source, a.k FROM (SELECT source, k, count(DISTINCT t) AS n FROM l WHERE k <> '' GROUP BY source, k) a
    JOIN hosts h ON a.source IS NOT DISTINCT FROM h.source WHERE a.n >= 5 AND a.n > h.n * 0.05::DOUBLE),
gone AS (SELECT r, sum(l.n) AS n FROM l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.k = f.k GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (gone.r IS NOT NULL AND n_words - gone.n < n_words * 0.75::DOUBLE) AS kept
FROM m LEFT JOIN gone USING (r)
"""
