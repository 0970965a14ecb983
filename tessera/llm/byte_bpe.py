"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code points, and these arrays of classes (letter, number,
space, ...). For each class the pre-tokeniser is a function from its state
before a character to its state after it. Such functions compose, and composing
is associative, so the state at every place follows from a scan: blocks of
characters are composed side by side with table look-ups on whole arrays, then
the blocks' totals. A table of (class, state before) then says where a piece
begins. No regex runs. Pieces are merged by rank once each and cached; token
ids are kept with the byte offset of every token, which decoding gathers by.

Defined results: a null text is encoded as the empty text, to no ids; repeated
rows are encoded alike; other columns stay, and results that clash with their
names get a leading underscore; texts are taken whole, in blocks of a fixed
number of code points, so a long text needs memory in proportion to itself only.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, mapped

#: Code points that one scan takes, the width of its blocks, and code points (or tokens) in a batch of texts.
BLOCK, WIDTH, CHUNK = 1 << 19, 512, 1 << 19
#: Merged pieces that a worker keeps, and the longest piece that it keeps.
CACHE_PIECES, CACHE_BYTES = 400_000, 64
#: The mark between two texts, above all code points.
END = 0x110000

# Classes of a character. A blank is split by what follows it: another blank or the end, or anything else.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_LAST, BLANK_LAST, BLANK, STOP = range(9)
# States after a character: nothing open, a run of letters, numbers or others, a space that the next run joins, blanks, one or two letters of a contraction to come.
NEW, LETTERS, NUMBERS, OTHERS, SPACE, BLANKS, ONE, TWO = range(8)
# White space of the regex class \s (Unicode White_Space): fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins before the character), each by class and state."""
    to, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for c, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS), (QUOTE1, OTHERS), (QUOTE2, OTHERS)):
        to[c] = run
        cut[c, [run, SPACE]] = False
    for c, state in ((QUOTE1, ONE), (QUOTE2, TWO)):  # a contraction begins where the quote itself begins a piece
        to[c, [s for s in range(8) if s not in (OTHERS, SPACE)]] = state
    to[LETTER, ONE], to[LETTER, TWO] = NEW, ONE
    cut[LETTER, [ONE, TWO]] = False
    to[SPACE_LAST], to[BLANK_LAST], to[BLANK], to[STOP] = SPACE, NEW, BLANKS, NEW
    cut[BLANK, BLANKS] = False
    return to, cut


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(composition table, action): all compositions of the classes' functions, identity last."""
    known: dict[tuple, int] = {}
    for f in [*map(tuple, to.tolist()), tuple(range(8))]:
        known.setdefault(f, len(known))
    queue = list(known)
    for f in queue:
        for g in to.tolist():
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    every = list(known)
    table = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
    return table, np.array(every, np.uint8)


TO, CUT = _automaton()
COMPOSE, ACT = _monoid(TO)
ELEMENT = np.array([ACT.tolist().index(f) for f in TO.tolist()], np.int32)
IDENTITY = ACT.tolist().index(list(range(8)))
_M, _COMPOSE = len(ACT), COMPOSE.ravel().astype(np.int32)
_QUOTE, _SPACE, _WHITE = 100, 101, 102
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, before what follows is looked at."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(END)), np.uint8, END)
        table = np.append(table, np.uint8(STOP))
        table[WHITE], table[0x20], table[0x27] = _WHITE, _SPACE, _QUOTE
        _classes = table
    return _classes


def _followed(points: np.ndarray, a: int, b: int) -> np.ndarray:
    """The classes of points[a:b], with regard to the two points that follow each."""
    ahead = np.full(b - a + 2, END, np.uint32)
    got = points[a : b + 2]
    ahead[: len(got)] = got
    base = classes()[ahead]
    out, n = base[:-2], b - a
    blank = (base >= _SPACE) | (base == STOP)
    last = ~blank[1 : n + 1]
    space, white = out == _SPACE, out == _WHITE
    quotes = np.flatnonzero(out == _QUOTE)
    out = out.copy()
    out[space | white] = BLANK
    out[space & last], out[white & last] = SPACE_LAST, BLANK_LAST
    x, y = ahead[quotes + 1], ahead[quotes + 2]
    s, t, m, d, r, e, v, l = (ord(k) for k in "stmdrevl")  # noqa: E741
    short = (x == s) | (x == t) | (x == m) | (x == d)
    long = ((x == r) & (y == e)) | ((x == v) & (y == e)) | ((x == l) & (y == l))
    out[quotes] = np.where(short, QUOTE1, np.where(long, QUOTE2, OTHER))
    return out


def _states(kinds: np.ndarray, start: int) -> np.ndarray:
    """The state before each character: an associative scan of the classes' functions."""
    n, rows = len(kinds), -(-len(kinds) // WIDTH)
    flat = np.full(rows * WIDTH, IDENTITY, np.int32)
    flat[:n] = ELEMENT[kinds]
    f = np.ascontiguousarray(flat.reshape(rows, WIDTH).T)
    for j in range(1, WIDTH):
        f[j] = _COMPOSE[f[j - 1] * _M + f[j]]
    begin, state = np.empty(rows, np.int32), start
    for r, total in enumerate(f[-1].tolist()):
        begin[r] = state
        state = int(ACT[total, state])
    after = ACT.ravel()[f * 8 + begin].T.ravel()[:n]
    return np.concatenate([np.array([start], np.uint8), after])


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in an array of code points; END stands between texts and is a piece of its own."""
    found, state = [], NEW
    for a in range(0, len(points), BLOCK):
        b = min(len(points), a + BLOCK)
        kinds = _followed(points, a, b)
        states = _states(kinds, state)
        found.append(np.flatnonzero(CUT[kinds, states[:-1]]) + a)
        state = int(states[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of lowest rank is joined, the leftmost of equals, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    none, get = 1 << 60, ranks.get
    cuts = list(range(len(piece) + 1))  # where parts begin and end
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, with a heap: a piece of n bytes takes about n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Vocabulary(dict):
    """Ranks from a file of ``base64 rank`` lines; as a mapping, ids by piece, merged on first use."""

    def __init__(self, data: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.old: dict[bytes, bytes] = {}
        size = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.length = np.fromiter(map(len, by_id), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        """The ids of a piece as 32-bit integers in a row, which are small to keep and joined at once.

        The cache has two halves: when the new one is full it becomes the old
        one, and what is asked for again moves up, so frequent pieces stay.
        """
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece, self.ranks)).tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of tokens of each text, all ids, all byte offsets within their texts)."""
        joined = "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        data = joined.encode()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(lengths + 1) - 1  # where each text's END is
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        points[stops[:-1]] = END
        starts = np.append(piece_starts(points), len(points))
        places = at[starts].tolist()
        lo, hi = np.searchsorted(starts, stops - lengths).tolist(), np.searchsorted(starts, stops).tolist()
        get, counts, out = self.__getitem__, np.zeros(len(texts), np.int64), []
        for k, (i, j) in enumerate(zip(lo, hi)):
            ids = b"".join(map(get, [data[a:b] for a, b in zip(places[i:j], places[i + 1 : j + 1])]))
            counts[k] = len(ids) // 4
            out.append(ids)
        ids = np.frombuffer(b"".join(out), np.int32)
        return counts, ids, self.offsets(counts, ids)

    def offsets(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The byte offset of each token in its text."""
        ends = np.cumsum(self.length[ids])
        begins, first = np.concatenate([[0], ends])[: len(ids)], np.cumsum(counts) - counts
        base = np.concatenate([[0], ends])[np.minimum(first, len(ids))]
        return (begins - np.repeat(base, counts)).astype(np.int32)

    def decode_batch(self, counts: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of bytes of each text, all bytes): each token's bytes are gathered to its offset."""
        n = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        stops = np.cumsum(counts)
        sizes = ends[stops] - ends[stops - counts]
        text_at = np.repeat(np.cumsum(sizes) - sizes, counts)
        place = text_at + offsets
        source = np.arange(int(n.sum())) + np.repeat(self.start[ids] - place, n)
        return sizes, self.bytes[source]


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(data: Broadcast) -> Vocabulary:
    key = hash(data.value)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(data.value)
    return _vocabularies[key]


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` in all, one row at least."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def _list(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])


def _broadcast(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids", offsets: str = "offsets", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of a text column and their byte offsets.

    With ``decoded`` the ids are decoded again in the same pass, into a column of
    that name: one Python worker a task holds the vocabulary and not two.

    ``ranks`` is the vocabulary file, read by the driver and broadcast: its size
    is that of the vocabulary. ``keep_text=False`` leaves the text column out.
    """
    data = _broadcast(docs.sparkSession, ranks)
    kept = [c for c in docs.columns if keep_text or c != text]
    ids, offsets = fresh(docs, ids), fresh(docs, offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(data)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rest = batch.select(kept)
            for a, b in _chunks(list(map(len, texts)), CHUNK):
                counts, got, places = vocabulary.encode_batch(texts[a:b])
                made = [_list(counts, got), _list(counts, places)]
                if back:
                    made.append(_binary(*vocabulary.decode_batch(counts, got, places)))
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *made], [*kept, ids, offsets, *back])

    back = [fresh(docs, decoded)] if decoded else []
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(x, T.ArrayType(T.IntegerType())) for x in (ids, offsets)] + [T.StructField(x, T.BinaryType()) for x in back])
    return mapped(docs, run, schema)


def decode(tokens: DataFrame, ranks: str, ids: str = "ids", offsets: str = "offsets", decoded: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``tokens`` with the bytes that the ids stand for; null ids give no bytes."""
    data = _broadcast(tokens.sparkSession, ranks)
    kept = [c for c in tokens.columns if keep_ids or c not in (ids, offsets)]
    decoded = fresh(tokens, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(data)
        for batch in batches:
            lists, places = batch.column(batch.schema.get_field_index(ids)), batch.column(batch.schema.get_field_index(offsets))
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in _chunks(n.tolist(), CHUNK // 2):
                got = lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                sizes, out = vocabulary.decode_batch(n[a:b].astype(np.int64), got, places.slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.select(kept).slice(a, b - a).columns, _binary(sizes, out)], [*kept, decoded])

    return mapped(tokens, run, T.StructType([tokens.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType())]))


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of (doc_id, text)."""
    tokens = encode(docs.select("doc_id", "text"), ranks, keep_text=False, decoded="decoded")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary_path() -> str:
    """The public vocabulary that the query uses."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
