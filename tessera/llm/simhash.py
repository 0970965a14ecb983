"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bits are split into blocks. Two fingerprints that differ in at
most ``bits`` places agree on all but ``bits`` of the blocks, so they share the
key made of some choice of the other blocks: they meet in a join on these keys
and their Hamming distance is then verified.

Equal fingerprints are one node from the start, so a group of exact copies adds
one row. Keys that more than ``crowd`` different fingerprints share would give
pairs by the square; their fingerprints are linked by a second exact way
instead: each is listed under itself and its 64 neighbours at distance one, and
those listed under one word (65 at most) are within two bits of each other.
Both ways together give the same components as all pairs, at most
crowd / 2 + 65 rows a fingerprint and key.

A similarity of 0.8 on shingles is some ten bits of 64, too many for blocks that
select anything. :func:`near_groups` therefore takes wide fingerprints of the
distinct shingles. Their ``WIDE`` bits are cut twice into ``BLOCK_COUNT`` blocks
of ``BLOCK_BITS``, once in order and once in strides, so that two blocks share a
bit at most. A pair of Jaccard similarity j, whose bits agree with probability
p = 1 - acos(2j / (1 + j)) / pi, shares a block with a probability of about
1 - (1 - p ** BLOCK_BITS) ** (2 * BLOCK_COUNT): 0.995 for j = 0.8, above 0.999
from 0.82. Pairs that share a block are candidates if their first ``HEAD`` longs
differ in no more bits than 0.8 does with five standard errors, which loses one
in three million at 0.8; the exact Jaccard similarity of their shingles then
decides. Two texts with nothing in common share a block by chance once in 2 **
BLOCK_BITS. From 2 ** 24 documents on, :func:`cut_for` takes a bit more for each
doubling, so that a document still meets less than one by chance in a block, and
as many blocks more as keep the probability for pairs at the limit.

Blocks move as (key, id), counted before they are joined, and pairs as (u, v); a
fingerprint's head is fetched for different pairs only. Blocks that more than
``crowd`` fingerprints share are worked off as in :mod:`tessera.llm.jaccard_join`:
held against a leader each, which links copies to it, a few times over; rows of
one component need no further link, and rows outside of a block's greatest
component are compared with all others of the block tile by tile. So every pair
that shares a block is decided, or is in one group already.

Texts that are the same but for lines they repeat are copies to
:func:`near_groups`, whatever their shingles say: both have the same lines in
the same order of first places. Texts, their lines and fingerprints are told
apart by two 64-bit hashes each.

Defined results: a null or blank text has fingerprint zero, linked like any
other; texts of fewer words than a shingle are one shingle; repeated rows share
a component; documents without an id never are a component's id unless all of it
lacks ids, which are whole numbers; an empty table gives an empty result; other
columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, fresh, mapped, stored, text_or_empty
from tessera.llm.components import components

SEED = 42
ONES = [1 << i for i in range(63)] + [-(1 << 63)]
#: Blocks of a fingerprint, and how many different fingerprints a key may have for the pairwise way.
BLOCKS, CROWD = 5, 48
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def shingle_hashes(text: str, k: int) -> list[int]:
    """XXH64 of each shingle of k words; A-Z in lower case, words joined by one space."""
    # bytes.lower and bytes.split know exactly A-Z and the six ASCII blanks
    words = text.encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def _fingerprint(hashes: list[int]) -> int:
    """The majority of each bit, as a signed long."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[a : a + AT_ONCE], ">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, k: int = 5, text: str = "text", name: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """``docs`` with the 64-bit SimHash of each text as a long."""
    kept, name = [c for c in docs.columns if keep_text or c != text], fresh(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            got = [_fingerprint(shingle_hashes(x or "", k)) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(got, pa.int64())], [*kept, name])

    return mapped(docs, run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.LongType())]))


def block_masks(bits: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - bits`` blocks, as signed longs."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    masks = [sum(x) for x in combinations(part, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, bits: int = 2, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between different fingerprints (column ``fp``) that have the components of all pairs within ``bits``."""
    if bits != 2:
        raise ValueError("the way for crowded keys is made for two bits")
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(block_masks(bits, blocks))))
    keyed = distinct.select("fp", F.inline(keys))
    met = keyed.groupBy("c", "m").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(keyed.join(met, ["c", "m"]), "simhash-met")
    few = met.filter(F.col("n") <= crowd).drop("n")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["c", "m"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v")
    crowded = met.filter(F.col("n") > crowd).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(m)) for m in ONES))
    listed = crowded.select("fp", F.explode(near).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = listed.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).filter("u <> v")
    return pairs.unionByName(stars).distinct()


def grouped(prints: DataFrame, bits: int = 2, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(fp, component_id, n): for each fingerprint of ``prints`` (doc_id, fp) the least doc_id reachable from it."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(distinct, bits, blocks, crowd))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id", "n")


# --- wide fingerprints, for a similarity on shingles ---

#: Blocks of a wide fingerprint in one cut, and their bits; longs that candidates are found by.
BLOCK_COUNT, BLOCK_BITS, HEAD = 160, 25, 8


class Cut(NamedTuple):
    """How wide fingerprints are cut: ``count`` blocks of ``bits`` bits, in order and again in strides."""

    bits: int = BLOCK_BITS
    count: int = BLOCK_COUNT

    @property
    def wide(self) -> int:
        return self.bits * self.count

    @property
    def longs(self) -> int:
        return -(-self.wide // 64)


CUT = Cut()
WIDE, LONGS = CUT.wide, CUT.longs
#: The probability with which a pair at the limit shares no block.
MISSED = 0.005
#: Fingerprints of a block that are compared as pairs, and leaders that a block has one after the other.
WIDE_CROWD, ROUNDS = 8, 2
#: Rows of a table that is broadcast at most.
BROADCAST_IDS = 200_000
_LANES = np.uint64(0x0101010101010101)


def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = _factors(LONGS)


def agreement(similarity: float) -> float:
    """The probability with which a bit is equal in two fingerprints of a Jaccard similarity."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def cut_for(n: int, similarity: float = 0.8) -> Cut:
    """Blocks for n documents: so wide that unlike texts rarely share one, so many that alike ones nearly always do."""
    bits = max(BLOCK_BITS, (max(n, 1) - 1).bit_length() + 1)
    count = math.ceil(math.log(MISSED) / math.log1p(-(agreement(similarity) ** bits)) / 2)
    return Cut(bits, max(count, -(-HEAD * 64 // bits)))


def most_bits(similarity: float) -> int:
    """The Hamming distance of ``HEAD`` longs up to which a pair of a Jaccard similarity is a candidate: the mean and five standard errors."""
    share, n = 1 - agreement(similarity), HEAD * 64
    return int(n * share + 5 * np.sqrt(n * share * (1 - share)))


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ones, twos): the sums of three bits in every place."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def wide_bits(hashes: list[list[int]], cut: Cut = CUT) -> np.ndarray:
    """The majority of each of ``cut.wide`` bits, for the shingle hashes of some texts: an array of texts by bits.

    A shingle's bits are its hash times fixed odd numbers, the high half folded
    into the low one. Seven shingles are added in all places at once; these sums
    are added up in byte lanes, 36 at a time, which a byte can hold.
    """
    factors, width = _FACTORS if cut == CUT else _factors(cut.longs), cut.wide
    words = len(factors)
    n = np.array([len(h) for h in hashes], np.int64)
    sevens = -(-n // 7)
    counts = np.zeros((len(hashes), words * 64), np.int32)
    total, firsts = int(sevens.sum()), np.cumsum(sevens) - sevens
    if not total:
        return counts[:, :width] > 0
    flat, real = np.zeros(total * 7, np.uint64), np.zeros(total * 7, bool)
    for f, h in zip(firsts.tolist(), hashes):
        flat[f * 7 : f * 7 + len(h)] = h
        real[f * 7 : f * 7 + len(h)] = True
    begins = np.concatenate([np.arange(f, f + m, 36) for f, m in zip(firsts, sevens)])
    owner = np.repeat(np.arange(len(n)), -(-sevens // 36))
    step = 8  # segments at once: what the processor's cache holds
    for a in range(0, len(begins), step):
        lo, hi = int(begins[a]), int(begins[a + step]) if a + step < len(begins) else total
        rows = flat[lo * 7 : hi * 7, None] * factors[None, :]
        rows ^= rows >> np.uint64(32)
        rows[~real[lo * 7 : hi * 7]] = 0
        r = rows.reshape(hi - lo, 7, words)
        s1, c1 = _added(r[:, 0], r[:, 1], r[:, 2])
        s2, c2 = _added(r[:, 3], r[:, 4], r[:, 5])
        ones, c3 = _added(s1, s2, r[:, 6])
        twos, fours = _added(c1, c2, c3)
        at, own = begins[a : a + step] - lo, owner[a : a + step]
        for b in range(8):
            shift = np.uint64(b)
            lanes = ((ones >> shift) & _LANES) + (((twos >> shift) & _LANES) << np.uint64(1)) + (((fours >> shift) & _LANES) << np.uint64(2))
            sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(len(at), -1)
            for i, d in enumerate(own.tolist()):
                counts[d, b::8] += sums[i]
    return counts[:, :width] * 2 > n[:, None]


def wide_fingerprints(docs: DataFrame, k: int = 5, text: str = "text", name: str = "wide", cut: Cut = CUT) -> DataFrame:
    """``docs`` without the text, with the wide fingerprint of its distinct shingles as an array of longs; the bits beyond ``cut.wide`` are 0."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(batch.schema.get_field_index(text)), [np.zeros(0, np.int64)]
            for a in range(0, len(texts), 16):
                bits = np.packbits(wide_bits([list(set(shingle_hashes(x or "", k))) for x in texts.slice(a, 16).to_pylist()], cut), axis=1)
                row = np.zeros((len(bits), cut.longs * 8), np.uint8)
                row[:, : bits.shape[1]] = bits
                out.append(row.view(">i8").astype(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * cut.longs, pa.int32()), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, lists], [*kept, name])

    return mapped(docs, run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.LongType()))]))


def _blocks(distinct: DataFrame, cut: Cut = CUT) -> DataFrame:
    """(key, id) for each block, of both cuts, of each fingerprint (id, wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, n = (1 << np.arange(cut.bits - 1, -1, -1)).astype(np.int64), 2 * cut.count
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(rows, axis=1)[:, :cut.wide]
                in_order, in_strides = bits.reshape(-1, cut.count, cut.bits) @ weight, weight @ bits.reshape(-1, cut.bits, cut.count)
                keys = np.concatenate([in_order, in_strides], axis=1) + (np.arange(n, dtype=np.int64) << cut.bits)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return mapped(distinct.select("id", "wide"), run, "key long, id long")


def close(pairs: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """Those of different pairs (u, v) whose heads (id, head) differ in at most so many bits."""
    x, y = (heads.select(F.col("id").alias(c), F.col("head").alias(h)) for c, h in (("u", "x"), ("v", "y")))
    bits = sum((F.bit_count(F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i)))) for i in range(1, HEAD)), F.bit_count(F.get("x", F.lit(0)).bitwiseXOR(F.get("y", F.lit(0)))))
    return pairs.join(x, "u").join(y, "v").filter(bits <= most).select("u", "v")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, grams): the distinct shingle hashes of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                sets = [np.unique(np.array(shingle_hashes(x or "", k), np.uint64)).view(np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "grams"])

    return mapped(texts.select("id", "text"), run, "id long, n int, grams array<long>")


def wide_links(distinct: DataFrame, similarity: float, sets_of: Callable[[DataFrame], DataFrame], crowd: int = WIDE_CROWD, cut: Cut = CUT) -> DataFrame:
    """(u, v): links between the ids of different wide fingerprints (id, wide) whose shingles are alike, as many as join their groups.

    ``sets_of`` gives (id, n, grams), the shingles of a table of ids: those of
    candidates, and of crowded blocks that leaders did not make one group.
    """
    from tessera.llm.jaccard_join import alike, leader_pairs, open_links  # here, so that workers do not load what it needs

    bits, percent = most_bits(similarity), round(100 * similarity)
    heads = stored(distinct.select("id", F.slice("wide", 1, HEAD).alias("head")), "wide-heads")
    keyed = _blocks(distinct, cut).withColumnRenamed("key", "g")
    shared = keyed.groupBy("g").agg(F.count("*").alias("all")).filter(F.col("all") > 1)
    met = stored(keyed.join(shared, "g"), "wide-met")

    def decided(pairs: DataFrame) -> DataFrame:
        near = stored(close(pairs, heads, bits), "wide-close")
        sets = sets_of(near.select(F.inline(F.array(F.struct(F.col("u").alias("id")), F.struct(F.col("v").alias("id"))))).distinct())
        return stored(alike(near, sets, percent).filter("links").select("u", "v"), "wide-links")

    few = met.filter(F.col("all") <= crowd).drop("all")
    pairs = few.select("g", F.col("id").alias("u")).join(few.select("g", F.col("id").alias("v")), "g").filter("u < v").select("u", "v").distinct()
    links = decided(pairs)
    crowded = met.filter(F.col("all") > crowd).select("g", "id", F.lit(1).alias("n"))
    crowded = stored(crowded.join(crowded.groupBy("id").agg(F.count("*").alias("deg")), "id"), "wide-crowded")
    if crowded.isEmpty():
        return links

    def still_open(blocks: DataFrame) -> DataFrame:
        """Those of some blocks that are not in one group yet, with the groups so far; groups only grow, so the others are done."""
        roots = components(links)
        now = stored(blocks.join(roots, blocks["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node"), "wide-rooted")
        several = now.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("g")
        return stored(now.join(several, "g"), "wide-open")

    tested, left = None, still_open(crowded)
    for _ in range(ROUNDS):
        now = stored(leader_pairs(left, 0), "wide-leaders")
        new = decided(now if tested is None else now.join(tested, ["u", "v"], "left_anti"))
        links, tested = links.unionByName(new), now if tested is None else tested.unionByName(now)
        if new.isEmpty():
            break
        left = still_open(left.drop("root"))
    if left.isEmpty():
        return links
    return links.unionByName(open_links(left, sets_of(left.select("id").distinct()), tested, percent, crowd=0))


def _side(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _two(c: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def _named(docs: DataFrame, text: str, doc_id: str, names: list[str]) -> DataFrame:
    """``docs`` with what tells a document: its id, the greatest number if it has none, and its text by two hashes."""
    return docs.withColumns(dict(zip(names, [F.coalesce(col(doc_id).cast("long"), F.lit((1 << 63) - 1)), *_two(text_or_empty(text))])))


NAME, STAYS = ["d", "t1", "t2"], ["keeper", "k1", "k2"]


def near_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", crowd: int = WIDE_CROWD, cut: Cut | None = None) -> DataFrame:
    """(d, t1, t2, keeper, k1, k2): for each document, by id and text hashes, the same of the one of its group that stays, the least."""
    lines = F.array_join(F.array_distinct(F.split(text_or_empty(text), "\n", -1)), "\n")  # different ones, in the order of their first places
    rows = _named(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), *(c.alias(n) for n, c in zip(("l1", "l2"), _two(lines)))), "text", "doc_id", NAME).drop("doc_id")
    cut = cut or cut_for(docs.count(), similarity)
    prints = stored(wide_fingerprints(rows, k, cut=cut).withColumns(dict(zip(("f1", "f2"), _two(F.col("wide"))))), "wide-prints")
    distinct = prints.groupBy("f1", "f2").agg(F.any_value("wide").alias("wide"), F.min(F.struct(*NAME)).alias("rep"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "wide-distinct")
    ids = stored(prints.drop("wide").join(distinct.select("f1", "f2", "id"), ["f1", "f2"]).select(*NAME, "l1", "l2", "id"), "wide-ids")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = _side(stored(distinct.join(_side(stored(wanted, "wide-wanted")), "id", "left_semi").select("id", "rep.*"), "wide-wanted"))
        return stored(_sets(rows.join(wanted, NAME).select("id", "text").dropDuplicates(["id"]), k), "wide-sets")

    same = ids.select("l1", "l2", "id").distinct()
    several = same.groupBy("l1", "l2").agg(F.min("id").alias("u"), F.max("id").alias("top")).filter("u < top").drop("top")
    copies = same.join(several, ["l1", "l2"]).select("u", F.col("id").alias("v")).filter("u <> v")
    roots = components(wide_links(distinct.select("id", "wide"), similarity, sets_of, crowd, cut).unionByName(copies))
    named = stored(distinct.select("id", "rep").join(roots, distinct["id"] == roots["node"], "left").select("id", "rep", F.coalesce("root", "id").alias("root")), "wide-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("keeper"))
    stays = named.join(least, "root").select("id", *(F.col("keeper")[x].alias(n) for x, n in zip(NAME, STAYS)))
    return ids.select(*NAME, "id").join(stays, "id").select(*NAME, *STAYS)


def dedup_near(docs: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", crowd: int = WIDE_CROWD) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, and one row of it."""
    names = [fresh(docs, f"near_{x}") for x in NAME]
    stay = near_groups(docs, k, similarity, text, doc_id, crowd).select(*(F.col(x).alias(n) for x, n in zip(STAYS, names))).distinct()
    out = _named(docs, text, doc_id, names).join(stored(stay, "near-stay"), names, "left_semi")
    return out.dropDuplicates(names).select(*map(col, docs.columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, fingerprint, component_id for each document; shingles of three words, links at two bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints = stored(fingerprints(docs, 3, name="fp", keep_text=False), "simhash-prints")
    return prints.join(grouped(prints).select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
