"""Images made in tasks: strips of rows are painted and compressed apart, and joined into one PNG or TIFF.

A strip of a PNG is a piece of one deflate stream that ends on a byte and refers
to nothing before it; the checksum of the whole follows from those of the
strips. A strip of a TIFF is a stream of its own, whose offset is the sum of the
sizes before it. What passes the driver is one compressed strip at a time, on
its way into the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a strip: what a task holds.
CELLS = 1 << 20
#: The modulus of Adler's checksum, and the size up to which a TIFF has short offsets: fixed values.
ADLER, SHORT = 65521, (1 << 32) - (1 << 16)


def joined_checksum(a: int, b: int, n: int) -> int:
    """The Adler-32 checksum of two texts in a row, from theirs and the length of the second."""
    a1, a2, b1, b2 = a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16
    return ((a2 + b2 + n * (a1 - 1)) % ADLER) << 16 | (a1 + b1 - 1) % ADLER


def placed(cells: DataFrame, box: tuple[int, int, int, int], origin: str = "upper", transpose: bool = False) -> tuple[DataFrame, int, int]:
    """(cells with row and col, height, width): x along the rows, from the bottom with the origin ``upper``; ``transpose`` exchanges the axes after that."""
    x0, x1, y0, y1 = map(int, box)
    row = F.lit(x1) - F.col("px") if origin == "upper" else F.col("px") - F.lit(x0)
    col = F.col("py") - F.lit(y0)
    size = (x1 - x0 + 1, y1 - y0 + 1)
    row, col, size = (col, row, size[::-1]) if transpose else (row, col, size)
    return cells.withColumns({"row": row.cast("long"), "col": col.cast("long")}), *size


def strips(cells: DataFrame, height: int, width: int, background: tuple[float, float, float], kind: str, cells_at_once: int = CELLS) -> tuple[DataFrame, int]:
    """((strip, data, checksum, size) of compressed strips, rows of a strip) for cells (row, col, r, g, b) with colours in [0, 1]."""
    rows = max(1, min(height, cells_at_once // width))
    many = -(-height // rows)
    ground = np.array(background, float)

    def paint(part: pd.DataFrame) -> pd.DataFrame:
        strip = int(part["strip"].iloc[0])
        own = part[part["at"] >= 0]
        image = np.empty((min(rows, height - strip * rows), width, 3), float)
        image[:] = ground
        image[own["at"].to_numpy(), own["col"].to_numpy()] = own[["r", "g", "b"]].to_numpy(float)
        image = np.clip((image * 255).astype(int), 0, 255).astype(np.uint8).reshape(len(image), -1)
        if kind == "png":
            raw = np.hstack([np.zeros((len(image), 1), np.uint8), image]).tobytes()
            pack = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = pack.compress(raw) + pack.flush(zlib.Z_FINISH if strip == many - 1 else zlib.Z_FULL_FLUSH)
        else:
            raw = image.tobytes()
            data = zlib.compress(raw, 6)
        return pd.DataFrame({"strip": [strip], "data": [data], "checksum": [zlib.adler32(raw)], "size": [len(raw)]})

    own = cells.select(F.expr(f"row div {rows}").alias("strip"), (F.col("row") % rows).alias("at"), "col", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    # A row for each strip, as strips without cells are painted too.
    every = cells.sparkSession.range(many).select(F.col("id").alias("strip"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("col"), *(F.lit(0.0).alias(c) for c in "rgb"))
    return own.unionByName(every).groupBy("strip").applyInPandas(paint, "strip long, data binary, checksum long, size long"), rows


def png_parts(made: Iterator, height: int, width: int) -> Iterator[bytes]:
    """A PNG file in pieces, from its strips in order."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    yield b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c")
    total = 1
    for s in made:
        total = joined_checksum(total, s.checksum, s.size)
        yield chunk(b"IDAT", bytes(s.data))
    yield chunk(b"IDAT", struct.pack(">I", total)) + chunk(b"IEND", b"")


def tiff_parts(made: Iterator, height: int, width: int, rows: int, data: int) -> Iterator[bytes]:
    """A TIFF file in pieces, from its strips in order; ``data`` is the sum of their sizes. Beyond 4 GB offsets are long."""
    many = -(-height // rows)
    large = data + 16 * many > SHORT
    head, word = (16, "Q") if large else (8, "I")
    start = head + data + data % 2
    yield struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if large else struct.pack("<2sHI", b"II", 42, start)
    offsets, sizes, at = [], [], head
    for s in made:
        offsets.append(at)
        sizes.append(len(s.data))
        at += len(s.data)
        yield bytes(s.data)
    yield bytes(data % 2)
    short, long_ = 3, 16 if large else 4
    # Size, bits, compression, colours, strips: the tags of the format, in order.
    tags = [(256, 4, [width]), (257, 4, [height]), (258, short, [8, 8, 8]), (259, short, [8]), (262, short, [2]), (273, long_, offsets), (277, short, [3]), (278, 4, [rows]), (279, long_, sizes)]
    count, rest = struct.pack("<Q" if large else "<H", len(tags)), b""
    after = start + len(count) + len(tags) * (20 if large else 12) + (8 if large else 4)
    out = [count]
    for tag, kind, values in tags:
        body = struct.pack(f"<{len(values)}{({3: 'H', 4: 'I', 16: 'Q'})[kind]}", *values)
        held = body.ljust(8 if large else 4, b"\0")
        if len(body) > len(held[: 8 if large else 4]):
            held, rest = struct.pack(f"<{word}", after + len(rest)), rest + body + bytes(len(body) % 2)
        out.append(struct.pack(f"<HH{word}", tag, kind, len(values)) + held)
    yield b"".join([*out, struct.pack(f"<{word}", 0), rest])


def write(cells: DataFrame, path: str, background: tuple[float, float, float] = (0, 0, 0), origin: str = "upper", transpose: bool = False, cells_at_once: int = CELLS) -> None:
    """Cells (px, py, r, g, b) as an image file, a TIFF if the path says so and else a PNG; no cells give one dot."""
    spark, kind = cells.sparkSession, "tiff" if path.lower().endswith((".tif", ".tiff")) else "png"
    box = cells.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    shown, height, width = placed(cells, box if box[0] is not None else (0, 0, 0, 0), origin, transpose)
    made, rows = strips(shown, height, width, background, kind, cells_at_once)
    made = made.persist(StorageLevel.DISK_ONLY)
    try:
        data = made.agg(F.sum(F.length("data"))).first()[0]
        in_order = made.orderBy("strip").toLocalIterator()
        parts = png_parts(in_order, height, width) if kind == "png" else tiff_parts(in_order, height, width, rows, data)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        try:
            for part in parts:
                out.write(bytearray(part))
        finally:
            out.close()
    finally:
        made.unpersist()
