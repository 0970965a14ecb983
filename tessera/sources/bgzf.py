"""Block-compressed text with an index of positions, as a Spark data source.

A BGZF file is a row of gzip members of at most 64 KB, so that it can be read
from the start of any of them; the index beside it (``.tbi``) says at which
virtual offsets (a member's offset and a place in its text) the lines of a name
and a range of positions are. The source plans one partition for each stretch of
the file that the regions asked for need, at most ``split`` bytes each, and a
task reads these bytes only. Without regions it plans the whole file in such
stretches, so that a large compressed text is read by many tasks; without an
index a file is one partition.

    spark.read.format("bgzf").option("regions", "2000:10-50,4000:10-50").load(path)
    df.write.format("bgzf").option("head", ...).mode("append").save(path)

Rows read are (value): lines that begin in a stretch, some of which may be
outside of the regions; :func:`lines` drops those. Rows written are (name, pos,
value), sorted by name and pos within their partition; each partition becomes a
file with its index. Files are opened by their URI through pyarrow, in tasks.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the two formats: the text of a member, the empty last member, and the levels of bins (first bin, bits of a position below it).
MEMBER = 65280
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
ZERO_BASED = 0x10000
#: Compressed bytes that a task reads.
SPLIT = 8 << 20


def member(text: bytes) -> bytes:
    """One gzip member with its own length in the extra field."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(text) + pack.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def member_size(head: bytes) -> int:
    """The bytes of a member, from its first ones."""
    extra, at = struct.unpack_from("<H", head, 10)[0] + 12, 12
    while at < extra:
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC":
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("no block-compressed file")


def members(file, at: int, to: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the members from one offset up to another, this one included."""
    file.seek(at)
    while at <= to:
        head = file.read(18)
        if len(head) < 18:
            return
        size = member_size(head)
        data = head + file.read(size - len(head))
        yield at, zlib.decompress(data[12 + struct.unpack_from("<H", data, 10)[0] : -8], -15)
        at += size


def runs_of(name: np.ndarray, window: np.ndarray) -> list[tuple[int, int]]:
    """The rows (first, one after the last) of each run of one name and window."""
    first = np.nonzero(np.concatenate([[True], (np.diff(name) != 0) | (np.diff(window) != 0)]))[0].tolist() if len(name) else []
    return list(zip(first, [*first[1:], len(name)]))


@dataclass
class Index:
    """The stretches of a file by name and bin, and the least offset by name and window of 2 ** 14 positions."""

    kind: int
    columns: tuple[int, int, int]
    skip: int
    bins: dict[str, dict[int, list[tuple[int, int]]]]
    windows: dict[str, list[int]]

    @classmethod
    def of(cls, names: list[str], name: np.ndarray, pos: np.ndarray, start: np.ndarray, end: np.ndarray, columns: tuple[int, int, int]) -> Index:
        """The index of sorted lines: numbers of their names, positions from 0, and virtual offsets."""
        window = pos >> LEVELS[-1][1]
        bins, windows = {n: {} for n in names}, {n: [] for n in names}
        for a, b in runs_of(name, window):
            n, w = names[name[a]], int(window[a])
            bins[n].setdefault(LEVELS[-1][0] + w, []).append((int(start[a]), int(end[b - 1])))
            windows[n] += [windows[n][-1] if windows[n] else 0] * (w - len(windows[n])) + [int(start[a])]
        return cls(ZERO_BASED, columns, 0, bins, windows)

    def packed(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.bins)
        out = [b"TBI\1", struct.pack("<8i", len(self.bins), self.kind, *self.columns, ord("#"), self.skip, len(names)), names]
        for n, bins in self.bins.items():
            out.append(struct.pack("<i", len(bins)))
            for b, parts in bins.items():
                out += [struct.pack("<Ii", b, len(parts)), *(struct.pack("<QQ", *p) for p in parts)]
            out.append(struct.pack(f"<i{len(self.windows[n])}Q", len(self.windows[n]), *self.windows[n]))
        data = b"".join(out)
        return b"".join(member(data[i : i + MEMBER]) for i in range(0, len(data), MEMBER)) + LAST

    @classmethod
    def parsed(cls, data: bytes) -> Index:
        if data[:4] != b"TBI\1":
            raise ValueError("no index of positions")
        n, kind, a, b, c, _, skip, size = struct.unpack_from("<8i", data, 4)
        names, at = [x.decode() for x in data[36 : 36 + size].split(b"\0")[:n]], 36 + size
        out = cls(kind, (a, b, c), skip, {}, {})
        for name in names:
            (many,), at, bins = struct.unpack_from("<i", data, at), at + 4, {}
            for _ in range(many):
                which, parts = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * parts}Q", data, at + 8)
                bins[which], at = list(zip(flat[::2], flat[1::2])), at + 8 + 16 * parts
            (many,) = struct.unpack_from("<i", data, at)
            out.windows[name], at = list(struct.unpack_from(f"<{many}Q", data, at + 4)), at + 4 + 8 * many
            # A bin beyond all positions has totals, no stretches.
            out.bins[name] = {w: parts for w, parts in bins.items() if w < 37449}
        return out

    def stretches(self, name: str, lo: int, hi: int) -> list[tuple[int, int]]:
        """Where lines of a name with positions lo to hi may be."""
        shift = 0 if self.kind & ZERO_BASED else 1
        lo, hi = max(0, lo - shift), min(hi - shift, (1 << 29) - 1)
        bins, windows = self.bins.get(name, {}), self.windows.get(name, [])
        if hi < lo or not bins:
            return []
        least = windows[min(lo >> LEVELS[-1][1], len(windows) - 1)] if windows else 0
        wanted = {first + (p >> bits) for first, bits in LEVELS for p in range(lo >> bits << bits, hi + 1, 1 << bits)}
        return [p for b, parts in bins.items() if b in wanted for p in parts if p[1] > least]

    def everything(self) -> list[tuple[int, int]]:
        return [p for bins in self.bins.values() for parts in bins.values() for p in parts]


def merged(parts: list[tuple[int, int]], split: int = SPLIT) -> list[tuple[int, int]]:
    """Stretches in order, those that touch as one while they are at most ``split`` compressed bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(parts)):
        if out and a < out[-1][1]:
            a = out[-1][1]
        if a >= b:
            continue
        if out and a == out[-1][1] and (b >> 16) - (out[-1][0] >> 16) <= split:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which may be a local one with or without a scheme, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/") if path.startswith(("file:", "/")) else os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file to read and seek in, on any file system that pyarrow knows."""
    where, at = _opened(path)
    return where.open_input_file(at)


def files_of(path: str) -> list[str]:
    """The compressed files of a path, which is one or a folder of them."""
    where, at = _opened(path)
    if where.get_file_info(at).type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(at)] if "://" in path and not path.startswith("file:") and path.endswith(at) else ""
    return sorted(f"{prefix}{i.path}" for i in where.get_file_info(fs.FileSelector(at)) if i.path.endswith(".gz"))


def index_of(path: str) -> Index | None:
    where, at = _opened(path + ".tbi")
    if where.get_file_info(at).type != fs.FileType.File:
        return None
    with where.open_input_file(at) as f:
        return Index.parsed(b"".join(text for _, text in members(f, 0, f.size())))


def head(path: str) -> list[str]:
    """The first lines of a file, those of its first member."""
    where, at = _opened(files_of(path)[0])
    with where.open_input_file(at) as f:
        return next((text for _, text in members(f, 0, 0)), b"").decode(errors="ignore").splitlines()


def regions_of(text: str) -> list[tuple[str, int, int]]:
    """``name:from-to,name:from-to``, bounds included; a name alone is all of it."""
    out = []
    for x in filter(None, text.split(",")):
        name, _, ends = x.partition(":")
        lo, _, hi = ends.partition("-")
        out.append((name, int(lo or 0), int(hi or (1 << 29))))
    return out


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int

    @property
    def size(self) -> int:
        return (self.end >> 16) - (self.start >> 16) + (MEMBER if self.end & 0xFFFF else 0)


def planned(path: str, regions: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> list[Stretch]:
    """What is read for some regions, or for all of a path: the indexes are read, not the files."""
    out = []
    for file in files_of(path):
        index = index_of(file)
        if index is None:
            where, at = _opened(file)
            out.append(Stretch(file, 0, where.get_file_info(at).size << 16))
            continue
        parts = index.everything() if regions is None else [p for r in regions for p in index.stretches(*r)]
        out += [Stretch(file, *p) for p in merged(parts, split)]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.regions = regions_of(options["regions"]) if "regions" in options else None

    def partitions(self) -> list[Stretch]:
        return planned(self.path, self.regions, self.split)

    def read(self, stretch: Stretch | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(stretch, Stretch):  # nothing was planned
            return
        where, at = _opened(stretch.path)
        with where.open_input_file(at) as f:
            rest = b""
            for offset, text in members(f, stretch.start >> 16, stretch.end >> 16):
                hi = stretch.end & 0xFFFF if offset == stretch.end >> 16 else len(text)
                lo = stretch.start & 0xFFFF if offset == stretch.start >> 16 else 0
                whole, cut, rest = (rest + text[lo:hi]).rpartition(b"\n")
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x in whole.split(b"\n") if x[:1] != b"#"], pa.binary()).cast(pa.string())], ["value"])
            if rest and rest[:1] != b"#":
                yield pa.RecordBatch.from_arrays([pa.array([rest.decode()])], ["value"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.head, self.overwrite = options["path"], options.get("head", ""), overwrite
        self.columns = tuple(int(x) for x in options.get("columns", "1,2,2").split(","))
        self.run = uuid.uuid4().hex
        where, at = _opened(self.path)
        where.create_dir(at, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, folder = _opened(self.path)
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.run}.tsv.gz"
        names: dict[str, int] = {}
        # Lines are kept as runs of a name and a window of the index: (name, position, start, end), in bytes of the text.
        runs, text, offsets, written = [], bytearray(self.head.encode()), [0], 0
        with where.open_output_stream(name, compression=None) as out:

            def flushed(all_: bool) -> None:
                nonlocal written
                while len(text) >= MEMBER or (all_ and text):
                    out.write(block := member(bytes(text[:MEMBER])))
                    offsets.append(offsets[-1] + len(block))
                    written += min(MEMBER, len(text))
                    del text[:MEMBER]

            for batch in batches:
                which = np.array([names.setdefault(n, len(names)) for n in batch.column(0).to_pylist()], np.int64)
                pos, lines = batch.column(1).to_numpy(zero_copy_only=False), [v.encode() + b"\n" for v in batch.column(2).to_pylist()]
                ends = written + len(text) + np.cumsum([len(v) for v in lines], dtype=np.int64)
                window = pos >> LEVELS[-1][1]
                for a, b in runs_of(which, window):
                    start = int(ends[a - 1]) if a else written + len(text)
                    if runs and runs[-1][0] == which[a] and runs[-1][1] >> LEVELS[-1][1] == window[a]:
                        runs[-1] = (*runs[-1][:3], int(ends[b - 1]))
                    else:
                        runs.append((int(which[a]), int(pos[a]), start, int(ends[b - 1])))
                text += b"".join(lines)
                flushed(False)
            flushed(True)
            out.write(LAST)
        where_at = np.array(offsets, np.int64)
        place = lambda u: (where_at[u // MEMBER] << 16) | (u % MEMBER)
        which, places, begin, end = np.array(runs, np.int64).reshape(-1, 4).T
        index = Index.of(list(names), which, places, place(begin), place(end), self.columns)
        with where.open_output_stream(name + ".tbi", compression=None) as out:
            out.write(index.packed())
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        """Files of other attempts go, and with ``overwrite`` those of other runs."""
        where, folder = _opened(self.path)
        kept = {m.name for m in messages if m} | {m.name + ".tbi" for m in messages if m}
        for i in where.get_file_info(fs.FileSelector(folder)):
            if i.path not in kept and (self.overwrite or self.run in i.path):
                where.delete_file(i.path)

    def abort(self, messages: list[_Written | None]) -> None:
        self.overwrite = False
        self.commit([])


@dataclass
class _Written(WriterCommitMessage):
    name: str


class Bgzf(DataSource):
    """The format ``bgzf``."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def lines(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, columns: tuple[int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """(value, parts): the lines of some regions and their columns; ``columns`` are those of name and position, by default the index's."""
    spark.dataSource.register(Bgzf)
    reader = spark.read.format("bgzf").option("split", split)
    reader = reader if regions is None else reader.option("regions", ",".join(f"{n}:{lo}-{hi}" for n, lo, hi in regions))
    out = reader.load(path).withColumn("parts", F.split("value", "\t"))
    if regions is not None:
        columns = columns or next((i.columns[:2] for i in map(index_of, files_of(path)) if i), (1, 2))
        name, pos = F.get("parts", F.lit(columns[0] - 1)), F.get("parts", F.lit(columns[1] - 1)).try_cast("double")
        keep = F.lit(False)
        for n, lo, hi in regions:
            keep = keep | ((name == n) & pos.between(lo, hi))
        out = out.filter(keep)
    return out


def write(df: DataFrame, path: str, name: str, pos: str, value: str, head: str = "", columns: tuple[int, int] = (1, 2)) -> None:
    """Lines ``value`` as files sorted by name and position, each with its index; ``head`` begins every file."""
    df.sparkSession.dataSource.register(Bgzf)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(pos).cast("long").alias("pos"), F.col(value).alias("value"))
    rows = rows.repartitionByRange("name", "pos").sortWithinPartitions("name", "pos", "value")
    rows.write.format("bgzf").option("head", head).option("columns", ",".join(map(str, (*columns, columns[1])))).mode("overwrite").save(path)
