"""Quality classifier: a generalised additive model with pairwise interactions.

Each document is measured once, as a whole, on a fixed list of features. The
model is a sum of look-up tables: one over the bins of each feature, and some
over the bins of two features. Tables are learned by cyclic boosting: round
after round, and feature after feature, a shallow tree fitted to the gradient of
the logistic loss is added to that feature's table at a small rate; then the
same with trees over pairs, for the pairs that explain most of what is left. A
score is the sum of the values of a document's bins, through the logistic
function: additions of whole columns.

The fit takes at most ``MOST_LABELLED`` labelled rows: of more, a share by the hash
of the id is filtered on the executors, and only that comes to the driver.

Defined results: a null text is empty, and empty texts are scored like others;
null labels are ignored; labels of documents that do not exist as well; several
labels of a document count each; without labels of both kinds the score is the
smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, fresh, mapped, stored

#: Labelled rows that a fit takes at most.
MOST_LABELLED = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST_WEIGHT = 48, 8, 120, 60, 8, 0.15, 2.0
CUT = 0.7
FEATURES = [
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digits", "symbols", "punctuation", "marks", "pipes", "not_ascii", "blanks",
    "distinct_words", "top_word", "same_as_last", "distinct_triples", "log_lines", "distinct_lines", "one_letter_words", "all_upper_words", "entropy",
]
_kinds: np.ndarray | None = None
UPPER, LOWER, DIGIT, SYMBOL, PUNCTUATION, BLANK, REST = range(7)


def kinds() -> np.ndarray:
    """The kind of each code point below 0x3000; what is above counts as rest."""
    global _kinds
    if _kinds is None:
        of = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Nd": DIGIT, "No": DIGIT, "Nl": DIGIT}
        by = {"S": SYMBOL, "P": PUNCTUATION, "Z": BLANK, "C": BLANK}
        table = [of.get(c := unicodedata.category(chr(i)), by.get(c[0], REST)) for i in range(0x3000)]
        for x in "#*$%&|<>@\\^_~":
            table[ord(x)] = SYMBOL
        _kinds = np.array([*table, REST], np.uint8)
    return _kinds


def features(text: str) -> list[float]:
    """The measures of one whole text, as :data:`FEATURES`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(points))
    count = np.bincount(kinds()[np.minimum(points, 0x3000)], minlength=7) / n
    low = np.bincount(np.minimum(points, 128), minlength=129)
    p = low[low > 0] / n
    words = text.split()
    many = max(1, len(words))
    by_word = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    return [
        math.log1p(len(points)), math.log1p(len(words)), sum(map(len, words)) / many, max(map(len, words), default=0), count[UPPER], count[DIGIT], count[SYMBOL], count[PUNCTUATION],
        (low[33] + low[63]) / n, low[124] / n, low[128] / n, count[BLANK],
        len(by_word) / many, max(by_word.values(), default=0) / many, sum(map(str.__eq__, words, words[1:])) / many, len(triples) / max(1, len(words) - 2), math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), sum(len(w) == 1 for w in by_word) / many, sum(c for w, c in by_word.items() if w.isupper() and len(w) > 1) / many, float(-(p * np.log(p)).sum()),
    ]


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, last, the features of each text as an array ``features`` (a free name)."""
    name = fresh(docs.select(*map(col, keep)), "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([features(x or "") for x in batch.column(len(keep)).to_pylist()], float).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * len(FEATURES), pa.int32()), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, name])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    return mapped(docs.select(*map(col, keep), col(text)), run, schema)


@dataclass
class Additive:
    """Look-up tables over bins; ``edges`` has the cuts of each feature, ``pairs`` (i, j, cuts, cuts, table)."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for i, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, i], side="right")]
        for i, j, e, f, t in self.pairs:
            out += t[np.searchsorted(e, x[:, i], side="right"), np.searchsorted(f, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + LEAST_WEIGHT)


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best split of bins in order; the cut is the first bin of the right side, 0 for none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * _leaf(gl, hl) + gr * _leaf(gr, hr) - g.sum() * _leaf(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values by bin of a tree of the depth over the bins of one feature."""
    gain, cut = _best(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """(values by cell, gain) of a tree that cuts one feature, and then the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            values, gain = np.empty_like(a), 0.0
            for rows in (slice(None, cut), slice(cut, None)):
                gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
                _, c = _best(gs, hs)
                for cols in (slice(None, c), slice(c, None)) if c else (slice(None),):
                    v = _leaf(gs[cols].sum(), hs[cols].sum())
                    values[rows, cols] = v
                    gain += v * gs[cols].sum()
            if gain > best:
                best, out = gain, values.T if turned else values
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of tables over features, then over the pairs that explain most of the rest."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = math.log(share / (1 - share))
    edges = [_cuts(x[:, i], BINS) for i in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return Additive(bias, edges, tables, [])
    bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    raw = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, b in enumerate(bins):
            g, h = slopes()
            n = len(tables[i])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            tables[i] += step
            raw += step[b]
    coarse = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cells[i] * shape[1] + cells[j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape), at

    gains = [(-_pair_tree(*histogram(i, j)[:2])[1], i, j) for i in range(len(bins)) for j in range(i + 1, len(bins)) if len(coarse[i]) and len(coarse[j])]
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            g, h, at = histogram(i, j)
            step = RATE * _pair_tree(g, h)[0]
            table += step
            raw += step.ravel()[at]
    return Additive(bias, edges, tables, pairs)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(measures: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Additive:
    """A model from ``measures`` (doc_id, and the features last) and ``labels``; of more than ``most`` labelled rows a share by hash is taken."""
    given = labels.select("doc_id", col(label).cast("double").alias("y")).filter("y IS NOT NULL")
    rows = measures.select("doc_id", col(measures.columns[-1]).alias("features"))
    rows = stored(rows.join(given, "doc_id").select(F.xxhash64("doc_id").alias("h"), "features", "y"), "quality-labelled")
    n = rows.count()
    if n > most:  # a little less than the share, so that chance does not lead above it
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int((most - 4 * most**0.5) / n * (1 << 20)))
    got = rows.toPandas()
    x, y, h = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float), got["h"].to_numpy()
    order = np.lexsort((*x.T, y, h))  # sums do not depend on the order of arrival
    return fit(x[order], y[order])


def scored(measures: DataFrame, model: Additive, name: str = "score") -> DataFrame:
    """``measures`` with the model's score (a free name) instead of the features, their last column."""
    *kept, features = measures.columns
    name = fresh(measures.select(*map(col, kept)), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(features)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(model.score(x))], [*kept, name])

    return mapped(measures, run, T.StructType([measures.schema[c] for c in kept] + [T.StructField(name, T.DoubleType())]))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, score, predicted for each document."""
    measures = stored(measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "quality-measures")
    model = train(measures.filter(remainder() != 2), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder() != 2))
    return scored(measures, model).select("doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
