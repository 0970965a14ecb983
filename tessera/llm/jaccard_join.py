"""N-gram Jaccard join as a blocked sparse product of document by n-gram.

Documents are rows and their different n-grams of words columns of a 0/1 matrix
A; the entries of A times its transpose are the overlaps, and two documents link
when the overlap is at least ``percent`` of the union. As such an overlap is at
least ceil(percent * n / 100) of either document's n columns, most of the product
is never formed:

1. In the order of hashes, documents that link share at least k of the first
   n - ceil(percent * n / 100) + k columns of each. With k about a tenth of n, a
   quarter of the matrix shows which documents can have a partner at all; the
   others are dropped (:func:`survivors`).
2. Documents with equal rows are one row, their class.
3. Of what is left, columns that one row has are dropped, and rows with too few
   of the others. In the order of rising column counts, rows that link share one
   of their first n - ceil(percent * n / 100) + 1 columns: these form blocks of
   the product (:func:`blocks`).
4. In each block, rows are held against the block's leader, the one that is in
   most blocks, which is linear; after that against the leader of those outside
   of the block's greatest component (:func:`leader_pairs`). Only pairs of
   different components are left to compare (:func:`open_links`): in small blocks
   as pairs, whose overlap is accumulated over all columns; in large ones tile
   by tile, where a task adds up the overlaps of two tiles and returns a forest
   of links. So no pair that can link is left out, and copies of one text cost
   their number and not its square.

Column identity is a 64-bit hash of the n-gram, class identity a 128-bit hash of
the row.

Defined results: texts of fewer words than an n-gram are one n-gram; texts
without words, null or not, have no n-gram and link with nothing; repeated rows
are documents of their own and share their class; a component's id is the least
doc_id in it, null if none has an id; an empty table gives an empty result;
columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, fresh, mapped, stored
from tessera.llm.components import components

SEED = 42
#: Rows of a block that are compared as pairs, rows of a tile, leaders taken one after the other, and rows broadcast at most.
CROWD, TILE, ROUNDS, BROADCAST_ROWS = 32, 256, 3, 200_000
#: A prefix has a column more for each so many, which it has to share too.
SPARE = 10
#: Hashes of words that a worker keeps.
KEPT_WORDS = 1 << 18
_MIX = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hashes of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def ngram_hashes(text: str, k: int, kept: dict[bytes, int]) -> np.ndarray:
    """The different k-grams of words of a text as sorted 64-bit hashes; ``kept`` has the hashes of words."""
    words = text.encode().lower().split()  # exactly A-Z and the six ASCII blanks
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _MIX[j % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def rows_of(docs: DataFrame, k: int = 4, text: str = "text", percent: int | None = None) -> DataFrame:
    """``docs`` without the text, with ``row``: n, the sorted hashes, and two longs that stand for all of them.

    With ``percent`` there are only as many of the hashes as :func:`survivors` needs.
    """
    kept, name = [c for c in docs.columns if c != text], fresh(docs.drop(col(text)), "row")
    kind = T.StructType.fromDDL("n int, grams array<long>, c1 long, c2 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [ngram_hashes(x or "", k, seen) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                marks = np.frombuffer(b"".join(blake2b(x.tobytes(), digest_size=16).digest() for x in sets), "<i8").reshape(-1, 2)
                n = pa.array([len(x) for x in sets], pa.int32())
                if percent is not None:
                    sets = [x[: len(x) - -(-len(x) * percent // 100) + len(x) // SPARE + 1] for x in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))
                row = pa.StructArray.from_arrays([n, grams, pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], ["n", "grams", "c1", "c2"])
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, row], [*kept, name])

    return mapped(docs, run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, kind)]))


def least_overlap(n: Column, percent: int) -> Column:
    """The overlap that a row of n columns has with any row it links to: ceil(percent * n / 100)."""
    return F.call_function("div", n * percent + 99, F.lit(100)).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def survivors(rows: DataFrame, percent: int) -> DataFrame:
    """(c1, c2, id): the different ones of the rows (r, n, grams, c1, c2) that share enough of their first columns with others."""
    narrow = rows.filter("n > 0").select("r", "c1", "c2")
    several = narrow.groupBy("c1", "c2").agg(F.min("r").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    copies = _small(stored(narrow.join(several, ["c1", "c2"]).filter("r > first").select("r"), "jaccard-copies"))
    # A partner may have less columns, down to what overlaps, and so share less of its own prefix.
    k = F.call_function("div", least_overlap(F.col("n"), percent), F.lit(SPARE)).cast("int") + 1
    cells = rows.filter("n > 0").join(copies, "r", "left_anti").select("r", k.alias("k"), F.explode("grams").alias("g"))
    shared = cells.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1").select("g")
    found = cells.join(shared, "g").groupBy("r", "k").agg(F.count("*").alias("shared")).filter("shared >= k").select("r")
    found = _small(stored(found, "jaccard-found"))
    return narrow.join(found, "r", "left_semi").select("c1", "c2", F.col("r").alias("id"))


def classes(docs: DataFrame, rows: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """(id, n, grams): the whole rows of those that may link, made again from their texts."""
    wanted = _small(stored(survivors(rows, percent), "jaccard-wanted"))
    whole = rows_of(docs.select(col(text)), k, text).select("row.*")
    return stored(whole.join(wanted, ["c1", "c2"]).select("id", "n", "grams").dropDuplicates(["id"]), "jaccard-classes")


def blocks(sets: DataFrame, percent: int) -> DataFrame:
    """(g, id, n): the prefix of each row of ``sets`` in the order of rising column counts, by column."""
    cells = sets.select("id", "n", F.explode("grams").alias("g"))
    counts = cells.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    shared = cells.join(counts, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("cells"))
    need, m = least_overlap(F.col("n"), percent), F.size("cells")
    # The columns that no other row has come first in the order; what the prefix has besides them is a slice.
    prefix = F.slice("cells", 1, m - need + 1)
    return shared.filter(m >= need).select("id", "n", F.explode(F.transform(prefix, lambda x: x["g"])).alias("g"))


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, links) for different pairs (u, v): the overlap accumulated over all columns."""
    both = pairs.join(sets.select(F.col("id").alias("v"), F.col("grams").alias("y")), "v").join(sets.select(F.col("id").alias("u"), F.col("grams").alias("x")), "u")
    overlap = F.size(F.array_intersect("x", "y")).cast("long")
    return both.select("u", "v", (overlap * 100 >= (F.size("x") + F.size("y") - overlap) * percent).alias("links"))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Whether rows of these numbers of columns can link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _rooted(met: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` with the component of each row so far."""
    roots = components(links)
    return met.join(roots, met["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node")


def leader_pairs(rooted: DataFrame, percent: int) -> DataFrame:
    """(u, v): each block's rows with one leader, of those outside of the greatest component where there are several."""
    sizes = rooted.groupBy("g", "root").agg(F.count("*").alias("m"), F.max(F.struct("deg", "id", "n")).alias("top"))
    main = sizes.groupBy("g").agg(F.max(F.struct("m", "root", "top")).alias("main"), F.max_by(F.struct("root", "top"), F.struct("m", "root")).alias("_"), F.count("*").alias("groups"))
    other = sizes.join(main.filter("groups > 1").select("g", F.col("main.root").alias("main")), "g").filter("root <> main").groupBy("g").agg(F.max("top").alias("top"), F.max_by("root", "top").alias("other"))
    met = rooted.join(other.select("g", "top", "other"), "g").filter(F.col("root") != F.col("other"))
    met = met.withColumn("n2", F.col("top.n")).filter(_sizes_fit("n", "n2", percent))
    return met.select(F.least("id", "top.id").alias("u"), F.greatest("id", "top.id").alias("v")).distinct()


def _tile_links(percent: int):
    """Links of a tile of rows outside of the greatest component with another tile, as a forest."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = part[part["mine"]].drop_duplicates("id"), part[~part["mine"]].drop_duplicates("id")
        out, boss = [], {}

        def root(x: int) -> int:
            while boss.get(x, x) != x:
                boss[x] = x = boss.get(boss[x], boss[x])
            return x

        if len(mine) and len(theirs):
            sizes = np.array([len(x) for x in theirs["grams"]])
            flat, first = np.concatenate(theirs["grams"].to_list()), np.cumsum(sizes) - sizes
            ids, roots = theirs["id"].to_numpy(), theirs["root"].to_numpy()
            columns, at = np.unique(flat, return_inverse=True)
            for u, r, grams in zip(mine["id"].tolist(), mine["root"].tolist(), mine["grams"]):
                has = np.zeros(len(columns) + 1, np.int64)
                where = np.searchsorted(columns, grams)
                hit = where < len(columns)
                hit[hit] = columns[where[hit]] == np.asarray(grams)[hit]
                has[where[hit]] = 1
                overlap = np.add.reduceat(has[at], first)
                for j in np.nonzero((overlap * 100 >= (sizes + len(grams) - overlap) * percent) & (roots != r))[0].tolist():
                    a, b = root(r), root(int(roots[j]))
                    if a != b:
                        boss[a] = b
                        out.append((u, int(ids[j])))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def open_links(rooted: DataFrame, sets: DataFrame, tested: DataFrame, percent: int, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """(u, v): links between rows of one block and different components, as many as join the components."""
    sizes = rooted.groupBy("g", "root").agg(F.count("*").alias("m")).groupBy("g").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), F.count("*").alias("groups"))
    sizes = sizes.filter("groups > 1").select("g", F.col("main.root").alias("main"), "all")
    open_ = stored(rooted.join(sizes, "g"), "jaccard-open")
    few, many = open_.filter(F.col("all") <= crowd), open_.filter(F.col("all") > crowd)
    u, v = (few.select("g", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("root").alias(f"root_{x}")) for x in "uv")
    pairs = u.join(v, "g").filter((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & _sizes_fit("n_u", "n_v", percent)).select("u", "v").distinct()
    links = alike(pairs.join(tested, ["u", "v"], "left_anti"), sets, percent).filter("links").select("u", "v")
    # Tiles: rows outside of the greatest component against all rows; a tile's number is a hash, its rows are about ``tile``.
    counts = stored(many.groupBy("g").agg(F.sum((F.col("root") != F.col("main")).cast("long")).alias("outside"), F.count("*").alias("rows")), "jaccard-tiles")
    if counts.isEmpty():
        return links
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("int")
    number = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), tiles(n)).cast("int")
    many = many.join(counts, "g")
    each = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    mine = many.filter("root <> main").select("g", number("outside", 1).alias("i"), each("rows").alias("j"), F.lit(True).alias("mine"), "id", "root")
    theirs = many.select("g", each("outside").alias("i"), number("rows", 2).alias("j"), F.lit(False).alias("mine"), "id", "root")
    dealt = mine.unionByName(theirs).join(sets.select("id", "grams"), "id")
    return links.unionByName(dealt.groupBy("g", "i", "j").applyInPandas(_tile_links(percent), "u long, v long"))


def links_of(sets: DataFrame, percent: int, crowd: int = CROWD, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """(u, v): links between the rows (id, n, grams) that have the components of all links."""
    prefix = stored(blocks(sets, percent), "jaccard-prefix")
    size = prefix.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g")
    met = prefix.join(size, "g", "left_semi")
    deg = met.groupBy("id").agg(F.count("*").alias("deg"))
    met = stored(met.join(deg, "id"), "jaccard-met")
    links = tested = None
    for _ in range(rounds):
        # At first every row is a component of its own, so that a block's leader is any other than the greatest.
        rooted = stored(_rooted(met, links) if links is not None else met.withColumn("root", F.col("id")), "jaccard-rooted")
        pairs = leader_pairs(rooted, percent)
        found = stored(alike(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), sets, percent), "jaccard-alike")
        new = found.filter("links").select("u", "v")
        links, tested = (new, found.select("u", "v")) if links is None else (links.unionByName(new), tested.unionByName(found.select("u", "v")))
        if new.isEmpty():
            break
    rooted = stored(_rooted(met, links), "jaccard-rooted")
    return links.unionByName(open_links(rooted, sets, tested, percent, crowd, tile))


def joined(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """``docs`` without the text, with n_shingles (the size of the set) and component_id (free names)."""
    numbered = rows_of(docs, k, text, percent)
    row = numbered.columns[-1]
    n, component, number, least = (fresh(numbered, x) for x in ("n_shingles", "component_id", "r", "least"))
    numbered = stored(numbered.withColumn(number, F.monotonically_increasing_id()), "jaccard-rows")
    rows = numbered.select(col(number).alias("r"), *(col(row)[c].alias(c) for c in ("n", "grams", "c1", "c2")))
    sets = classes(docs, rows, k, percent, text)
    roots = components(links_of(sets, percent, crowd, tile))
    marks = rows.select(F.col("r").alias("node"), "c1", "c2")
    roots = _small(stored(marks.join(_small(roots), "node").select("c1", "c2", "root"), "jaccard-roots"))
    ids = numbered.select(col(number).alias("r"), col(doc_id).cast("long").alias("d"), *(col(row)[c].alias(c) for c in ("n", "c1", "c2"))).filter("n > 0")
    ids = stored(ids.join(roots, ["c1", "c2"], "left"), "jaccard-ids")
    linked, alone = ids.filter("root IS NOT NULL"), ids.filter("root IS NULL")
    linked = linked.join(linked.groupBy("root").agg(F.min("d").alias("least")), "root")
    alone = alone.join(alone.groupBy("c1", "c2").agg(F.min("d").alias("least"), F.count("*").alias("copies")).filter("copies > 1"), ["c1", "c2"])
    # Texts that have neither a link nor a copy keep their own id.
    named = linked.select("r", "least").unionByName(alone.select("r", "least")).select(F.col("r").alias(number), F.struct("least").alias(least))
    out = numbered.select(*(col(c) for c in numbered.columns if c != row), col(row)["n"].cast("long").alias(n)).join(named, number, "left")
    return out.withColumn(component, F.when(col(least).isNotNull(), col(least)["least"]).otherwise(col(doc_id).cast("long"))).drop(number, least)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_shingles, component_id for each document."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
