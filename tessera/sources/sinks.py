"""Sinks: formatted tables, block-indexed results, sparse matrices, geometry, images and pages.

Tables go through Spark's writers. What is small by nature (an image, a page, a
stage graph) is made on the driver and written as one file.
"""

from __future__ import annotations

import gzip
import html
import io
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.binning import CURVE, blocked, curve_key
from tessera.sources import bgzf


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def gzipped(data: bytes) -> bytes:
    """Gzip without a time, so that equal data are equal files."""
    held = io.BytesIO()
    with gzip.GzipFile(fileobj=held, mode="wb", mtime=0) as f:
        f.write(data)
    return held.getvalue()


def formatted(df: DataFrame, fmt: str = "%.4e", columns: list[str] | None = None) -> DataFrame:
    """Floating columns (or the named ones) as text of a format."""
    chosen = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.format_string(fmt, F.col(f"`{c}`")) for c in chosen})


def write_tsv(df: DataFrame, path: str, fmt: str | None = None, compress: bool = True) -> None:
    out = formatted(df, fmt) if fmt else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def _block_lines(rows: DataFrame, k: int, top: int, block: float, scale: float, off_x: float, off_y: float, size_x: float, size_y: float) -> tuple[DataFrame, str]:
    """(rows with BLOCK, X and Y and their line ``value``, the lines before them)."""
    cols = ["BLOCK", "X", "Y", *(f"K{i + 1}" for i in range(top)), *(f"P{i + 1}" for i in range(top))]
    head = [f"##K={k};TOPK={top}", f"##BLOCK_SIZE={block:g};BLOCK_AXIS=X;INDEX_AXIS=Y", f"##OFFSET_X={off_x:g};OFFSET_Y={off_y:g};SIZE_X={size_x:g};SIZE_Y={size_y:g};SCALE={scale:g}", "#" + "\t".join(cols)]
    out = formatted(rows, "%.2e", [f"P{i + 1}" for i in range(top)])
    return out.withColumn("value", F.concat_ws("\t", *(F.col(c).cast("string") for c in cols))), "\n".join(head) + "\n"


def write_blocks(decoded: DataFrame, path: str, k: int, top: int, block: float = 2000, scale: float = 100, off_x: float = 0.0, off_y: float = 0.0, size_x: float = 0.0, size_y: float = 0.0) -> None:
    """Block-indexed results: metadata, then rows sorted by block and Y. Every file has the metadata, so each can be read by itself; a block may be several files.

    Numbers are sorted, and become lines where they are written.
    """
    keys = ["BLOCK", "Y", "X"]
    kept = [*keys, *(f"{c}{i + 1}" for c in "KP" for i in range(top))]
    rows = blocked(decoded, block, scale, off_x, off_y).select(*kept).repartitionByRange(*keys).sortWithinPartitions(*keys)
    out, head = _block_lines(rows, k, top, block, scale, off_x, off_y, size_x, size_y)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    out.select(F.when(first, F.concat(F.lit(head), F.col("value"))).otherwise(F.col("value")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_blocks_indexed(decoded: DataFrame, path: str, k: int, top: int, block: float = 2000, scale: float = 100, off_x: float = 0.0, off_y: float = 0.0, size_x: float = 0.0, size_y: float = 0.0) -> None:
    """The same, block-compressed and with an index of BLOCK and Y beside each file, from which a box can be read alone."""
    out, head = _block_lines(blocked(decoded, block, scale, off_x, off_y), k, top, block, scale, off_x, off_y, size_x, size_y)
    bgzf.write(out, path, "BLOCK", "Y", "value", head, (1, 3))


def block_table(decoded: DataFrame, path: str, **options) -> None:
    """The same as Parquet partitioned by block, for pruned reads."""
    blocked(decoded, **options).repartition("BLOCK").sortWithinPartitions("Y", "X").write.mode("overwrite").partitionBy("BLOCK").parquet(path)


def write_curve(df: DataFrame, path: str, cell: float, box: tuple[float, float, float, float], x: str = "X", y: str = "Y") -> None:
    """Rows in the order of a Z curve over cells, in files of a range of it each, so that a box needs few of them: see :func:`readers.curve`."""
    key = curve_key(F.col(x), F.col(y), cell, box)
    out = df.withColumn(CURVE, key).repartitionByRange(CURVE).sortWithinPartitions(CURVE, x, y)
    out.write.mode("overwrite").parquet(path)


def sparse_matrix(dge: DataFrame, features: DataFrame, precision: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, barcodes, entries) of a unit by gene table with x and y: names and indices from 1, in the order of names.

    Units are numbered by range partition and place, so no task sees them all.
    """
    f = features.select("gene").distinct().withColumn("gene_idx", F.row_number().over(Window.orderBy("gene")))
    u = dge.groupBy("ox", "oy", "hx", "hy").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("n").alias("tot"))
    u = numbered(u, "barcode_idx", "ox", "oy", "hx", "hy")
    name = F.format_string(f"%d_%d.%d_%.{precision}f_%.{precision}f_%d", F.col("barcode_idx"), F.col("ox"), F.col("oy"), F.col("x"), F.col("y"), F.col("tot").cast("long"))
    entries = dge.join(u.select("ox", "oy", "hx", "hy", "barcode_idx"), ["ox", "oy", "hx", "hy"]).join(f, "gene").select("gene_idx", "barcode_idx", F.col("n").cast("long").alias("n"))
    return f, u.withColumn("barcode", name), entries


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` with numbers from 1 in the order of keys: ranges are sorted apart, and each begins after those before it."""
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).persist()
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy(*keys)
    return part.withColumn("_i", F.row_number().over(w)).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def write_matrix(dge: DataFrame, features: DataFrame, path: str, symbol: str = "Gene Expression") -> None:
    """features.tsv, barcodes.tsv and matrix.mtx folders in the layout of single-cell tools."""
    spark = dge.sparkSession
    dge.write.mode("overwrite").parquet(f"{path}/counts")  # binned once, and read for the units, the entries and their numbers
    f, u, e = sparse_matrix(spark.read.parquet(f"{path}/counts"), features)
    f.orderBy("gene_idx").select(F.concat_ws("\t", "gene", "gene", F.lit(symbol))).coalesce(1).write.mode("overwrite").option("compression", "gzip").text(f"{path}/features")
    u.orderBy("barcode_idx").select("barcode").write.mode("overwrite").option("compression", "gzip").text(f"{path}/barcodes")
    size = f"%%MatrixMarket matrix coordinate integer general\n%\n{f.count()} {u.count()} {e.count()}"
    e.select(F.concat_ws(" ", "gene_idx", "barcode_idx", "n")).write.mode("overwrite").text(f"{path}/matrix")
    write_bytes(spark, f"{path}/matrix/head.txt", (size + "\n").encode())  # first in the order of names


def nested(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Rings as polygons: those inside of an even number of others are outlines, the others holes of the least outline around them."""

    def inside(ring: list, other: np.ndarray) -> bool:
        # Rings do not cross but may touch in corners: the middles of the edges decide.
        middle = (np.array(ring) + np.roll(np.array(ring), -1, 0)) / 2
        (x1, y1), (x2, y2) = other.T, np.roll(other, -1, 0).T
        x, y = middle[:, :1], middle[:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = ((y < y1) != (y < y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return bool((cross.sum(1) % 2).mean() > 0.5)

    rings = [r for r in rings if r]
    each = [np.array(r, float) for r in rings]
    size = [abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)))) / 2 for p in each]
    boxes = [(*p.min(0), *p.max(0)) for p in each]
    around = [[j for j, o in enumerate(each) if j != i and size[j] > size[i] and boxes[j][0] <= boxes[i][0] and boxes[j][1] <= boxes[i][1] and boxes[j][2] >= boxes[i][2] and boxes[j][3] >= boxes[i][3] and inside(rings[i], o)] for i in range(len(rings))]
    out = {i: [rings[i]] for i in range(len(rings)) if len(around[i]) % 2 == 0}
    for i, outer in enumerate(around):
        if i not in out:
            out[min((j for j in outer if len(around[j]) == len(outer) - 1), key=lambda j: size[j])].append(rings[i])
    return list(out.values())


def geojson(rings: list[list[tuple[float, float]]], buffer: float = 0.0) -> str:
    """Rings as a multipolygon with holes; the property ``buffer`` says how far beyond the outlines the region reaches."""
    shapes = [[[list(p) for p in [*r, r[0]]] for r in polygon] for polygon in nested(rings)]
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"buffer": buffer} if buffer else {}, "geometry": {"type": "MultiPolygon", "coordinates": shapes}}]})


def png(image: np.ndarray) -> bytes:
    """An H x W x 3 array of bytes as PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), image.reshape(h, -1)]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def report(table: list[dict], title: str = "Factors", tree: bytes | None = None, newick: str = "") -> str:
    """A page with one row a factor; text on colours is black or white by their luminance."""
    import base64

    names = list(table[0]) if table else []
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    if tree:
        out.append(f"<img alt='tree' src='data:image/png;base64,{base64.b64encode(tree).decode()}'>")
    out.append("<table><tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + "</tr>")
    for row in table:
        cells = []
        for n in names:
            style = ""
            if n.upper() == "RGB":
                r, g, b = (int(x) for x in str(row[n]).split(","))
                ink = "#000" if 0.299 * r + 0.587 * g + 0.114 * b > 186 else "#fff"
                style = f" style='background:rgb({r},{g},{b});color:{ink}'"
            cells.append(f"<td{style}>{html.escape(str(row[n]))}</td>")
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "".join([*out, "</table>", f"<pre>{html.escape(newick)}</pre>" if newick else "", "</body></html>"])
