"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its s-mers (by a
mixed hash) is the first or the last one. Whether it is depends on the k-mer
alone, so an edit disturbs the anchors that overlap it and no others: texts
that share a passage share its anchors, at places that differ by one shift.
Every run of k - s + 1 k-mers has a syncmer in it.

A fingerprint is the sketch of the ``size`` least different anchor hashes, each
with the place where the text has it first: eight hexadecimal digits each. The
likeness of two fingerprints matches their anchors by position: of the least
``size`` hashes of both together, those count as shared that both have in the
same order of places (the longest such chain). Without moved parts this is an
estimate of the Jaccard similarity of the anchor sets; parts that were moved
past each other count once.

Defined results: a null or empty text has the empty fingerprint, and two empty
fingerprints have likeness 1; a text without a syncmer has one anchor, the hash
of all of it; repeated rows have equal fingerprints; an empty table gives an
empty result. :func:`fingerprints` keeps other columns, :func:`against_next`
gives :data:`PAIRS` alone. Documents are in the order of doc_id (a whole number),
null first, those of equal doc_id by a hash of their text, then by their text;
rows of one id and one text are one task's work.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, fresh, mapped, partitions, text_or_empty

K, S, SIZE = 15, 5, 96
#: Code points hashed at once.
CHUNK = 1 << 20
_MIX, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _rolled(points: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """The mixed hash of the n code points from each place (all places if ``at`` is None)."""
    many = len(points) - n + 1 if at is None else len(at)
    h = np.full(many, np.uint64(n), np.uint64)
    for j in range(n):
        h *= _ROLL
        h ^= points[j : j + many] if at is None else points[at + j]
        h *= _MIX
    return _mixed(h)


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, place, 32-bit hash) of every closed syncmer, in order."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    which, place, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    w = k - s + 1
    for a in range(0, max(0, len(points) - k + 1), CHUNK):
        part = points[a : a + CHUNK + k - 1]
        h = (_rolled(part, None, s) >> np.uint64(32)).astype(np.uint32)
        least, span = h, 1
        while span * 2 <= w:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(h) - w + 1], least[w - span :][: len(h) - w + 1])
        at = np.flatnonzero((least == h[: len(least)]) | (least == h[w - 1 :]))
        doc = np.searchsorted(begins, at + a, side="right") - 1
        inside = at + a + k <= begins[doc] + lengths[doc]  # not across the mark between texts
        at, doc = at[inside], doc[inside]
        which.append(doc)
        place.append(at + a - begins[doc])
        found.append(_rolled(part, at, k) >> np.uint64(32))
    return np.concatenate(which), np.concatenate(place), np.concatenate(found)


_HASH, _PLACE = np.uint64(32), np.uint64(0xFFFFFFFF)


def sketches(texts: list[str], k: int = K, s: int = S, size: int = SIZE) -> list[np.ndarray]:
    """The least different anchor hashes of each text, ascending, in the high 32 bits; the first place of each in the low ones."""
    doc, place, h = anchors(texts, k, s)
    keys, first = np.unique((doc.astype(np.uint64) << _HASH) | h, return_index=True)
    doc, found = (keys >> _HASH).astype(np.int64), (keys << _HASH) | (place[first].astype(np.uint64) & _PLACE)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        a, b = ends[i], ends[i + 1]
        if a == b and text:
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
            out.append(np.frombuffer(digest, ">u4").astype(np.uint64) << _HASH)
        else:
            out.append(found[a : min(b, a + size)])
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def in_line(places: np.ndarray) -> int:
    """The length of the longest rising subsequence."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    ends: list[int] = []
    for x in places.tolist():
        i = bisect_left(ends, x)
        ends[i : i + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of anchors that two sketches have in common in the same order of places."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = a >> _HASH, b >> _HASH
    both = np.union1d(x, y)[:size]  # of the union, the least
    _, i, j = np.intersect1d(x[x <= both[-1]], y[y <= both[-1]], assume_unique=True, return_indices=True)
    return in_line((b[j] & _PLACE)[np.argsort(a[i] & _PLACE)]) / len(both)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    name = fresh(docs, name)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            got = [as_text(x) for x in sketches(texts, k, s, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names)

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def _numbers(values: list) -> Column:
    """A constant array of longs, null for None: one expression whatever its length."""
    return F.transform(F.split(F.lit(",".join("" if x is None else str(x) for x in values)), ","), lambda x: x.try_cast("long"))


def _place(d: Column, h: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds (id, hash) are at or below (d, h): a binary search, of as many steps as the number has bits."""
    if not bounds:
        return F.lit(0)
    ids, hashes = _numbers([x for x, _ in bounds]), _numbers([x for _, x in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, s: Column) -> Column:
        x, y = F.get(ids, at + s - 1), F.get(hashes, at + s - 1)
        return F.when((x < d) | ((x == d) & (y <= h)), at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _bounds(cuts: list[int]) -> list[tuple[int, int]]:
    """Bounds from quantiles of ids. An id that is several quantiles holds whole parts: it is divided by hash into as many."""
    out = []
    for x in sorted(set(cuts)):
        m = cuts.count(x)
        out += [(x, j * (1 << 64) // m - (1 << 63)) for j in range(m)]
    return out


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, extra, doc_id, text): documents in order within each partition, the successor of its last one after them.

    Texts move once. Bounds are quantiles of the ids; what comes to the driver is
    one id a partition. The first document of each part goes to the part before
    as well (that of all to the last part), flagged as extra.
    """
    spark = docs.sparkSession
    n, least = partitions(spark), -(1 << 63)
    d = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(least)).alias("d"), F.xxhash64(text_or_empty(text)).alias("h"), col(doc_id).alias("doc_id"), col(text).alias("text"))
    cuts = d.agg(F.percentile_approx("d", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    bounds = _bounds(cuts or [])
    part = _place(F.col("d"), F.col("h"), bounds)
    firsts = {r["p"]: tuple(r["m"]) for r in d.groupBy(part.alias("p")).agg(F.min(F.struct("d", "h")).alias("m")).collect()}  # one row a part
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first part is after the last
    parts = range(len(bounds) + 1)
    lead = [_numbers([firsts.get(p, (None, None))[i] for p in parts]) for i in (0, 1)]
    placed = d.withColumn("part", part)
    # Of the rows that are equal to a part's first one, one goes to the part before as well.
    leads = placed.filter((F.col("d") == F.get(lead[0], F.col("part"))) & (F.col("h") == F.get(lead[1], F.col("part"))))
    one = F.row_number().over(Window.partitionBy("part").orderBy("d", "h"))
    other = F.get(_numbers([before.get(p) for p in parts]), F.col("part")).cast("int")
    extra = leads.withColumn("one", one).filter("one = 1").select("d", "h", "doc_id", "text", other.alias("part"), F.lit(True).alias("extra"))
    moved = placed.select("d", "h", "doc_id", "text", "part", F.lit(False).alias("extra")).unionByName(extra)
    return moved.repartitionById(max(n, 1), F.col("part")).sortWithinPartitions("part", "extra", "d", "h", "text").select("part", "extra", "doc_id", "text")


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """:data:`PAIRS`: each document's fingerprint against its edited text's and the next document's.

    The edited text has the last quarter replaced by the next document's beginning.
    """

    def judged(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last, which is the successor of the one before."""
        edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(texts, texts[1:])]
        prints, other = sketches(texts, k, s, size), sketches(edited, k, s, size)
        rows = [
            (i, len(x), hashlib.sha256(e.encode()).hexdigest(), as_text(p), as_text(q), likeness(p, q, size), likeness(p, nxt, size))
            for i, x, e, p, q, nxt in zip(ids, texts, edited, prints, other, prints[1:])
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [x.split()[0] for x in PAIRS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars, part, ended = [], [], 0, None, True
        for batch in batches:
            for p, extra, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    ids, texts, chars, part, ended = [], [], 0, p, False
                if ended:
                    continue  # further documents with the successor's id
                ids.append(i)
                texts.append(x or "")
                chars += len(texts[-1])
                if extra or (chars > CHUNK and len(texts) > 1):
                    yield judged(ids, texts)
                    ids, texts, ended = ids[-1:], texts[-1:], bool(extra)
                    chars = len(texts[0])

    return mapped(in_order(docs, doc_id, text), run, PAIRS)


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def matches(left: DataFrame, right: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(left_id, right_id, shift, n): how many anchors two documents share at each displacement.

    ``left`` is a stated set of queries, held against all of ``right``: an anchor
    of n texts there gives n rows a query that has it. Hashes that one text has
    many times meet once, at their first place, so that a repeated passage adds
    one row.
    """

    def placed(docs: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, at, h = anchors([x or "" for x in batch.column(1).to_pylist()], k, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(h.astype(np.int64)), pa.array(at)], [name, "h", f"at_{name}"])

        out = mapped(docs.select(col(key).alias(name), col(text)), run, T.StructType([T.StructField(name, docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField(f"at_{name}", T.LongType())]))
        return out.groupBy(name, "h").agg(F.min(f"at_{name}").alias(f"at_{name}"))

    both = placed(left, "left_id").join(placed(right, "right_id"), "h")
    return both.groupBy("left_id", "right_id", (F.col("at_right_id") - F.col("at_left_id")).alias("shift")).agg(F.count("*").alias("n"))
