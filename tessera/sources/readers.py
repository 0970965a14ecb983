"""Readers: tab-separated tables, vendor molecule tables, models, anchors, block-indexed results, geometry."""

from __future__ import annotations

import io
import json
import math
import re
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import binning
from tessera.operators.filters import without
from tessera.schema import factor_columns, micrometres, normalised, theta
from tessera.sources import bgzf

#: Control probes of the imaging platforms: fixed values.
CONTROLS = {"cosmx": "negprb|negative|systemcontrol|falsecode", "vizgen": "blank", "xenium": "blank|negcontrol|antisense|unassigned|deprecated"}
PIXELS = "X double, Y double, gene string, Count int"


def text_of(spark: SparkSession, path: str) -> str:
    """A small file as text, through Spark, so that any file system will do."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, mode: str | None = None, sep: str = "\t", repartition: int = 0) -> DataFrame:
    """A tab-separated table, plain or gzip. A gzip file is read by one task: ``repartition`` spreads its rows."""
    reader = spark.read.option("sep", sep).option("header", header)
    out = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    out = normalised(out, mode) if mode else out
    return out.repartition(repartition) if repartition else out


def pixels(spark: SparkSession, path: str, key: str = "Count", mu_scale: float = 1.0, schema: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """X, Y, gene, counts and the columns ``keep`` of a pixel table (Parquet or text), in micrometres."""
    out = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tsv(spark, path, schema)
    out = normalised(out, "xy")
    out = out.select(F.col("X").cast("double").alias("X"), F.col("Y").cast("double").alias("Y"), F.col("gene").cast("string").alias("gene"), F.col(key), *keep)
    return micrometres(out, mu_scale) if mu_scale != 1 else out


# --- vendor tables ---


def _molecules(df: DataFrame, x: str, y: str, gene: str, scale: float, keep: list[str], control: str | None) -> DataFrame:
    df = without(df, control, gene) if control else df
    out = df.select((F.col(x).cast("double") * F.lit(float(scale))).alias("X"), (F.col(y).cast("double") * F.lit(float(scale))).alias("Y"), F.col(gene).cast("string").alias("gene"), *keep)
    return out.groupBy("X", "Y", "gene", *keep).agg(F.count("*").cast("int").alias("Count"))


def cosmx(df: DataFrame, px_um: float = 0.12, keep: tuple[str, ...] = (), control: str | None = CONTROLS["cosmx"]) -> DataFrame:
    """CosMx molecules: pixel places to micrometres, control probes out, equal places summed."""
    return _molecules(df, "x_global_px", "y_global_px", "target", px_um, list(keep), control)


def vizgen(df: DataFrame, control: str | None = CONTROLS["vizgen"]) -> DataFrame:
    """MERSCOPE molecules, each with a count of one and its own id."""
    df = without(df, control, "gene") if control else df
    return df.select(F.col("global_x").cast("double").alias("X"), F.col("global_y").cast("double").alias("Y"), "gene", "transcript_id", F.lit(1).alias("Count"))


def xenium(df: DataFrame, least_quality: float = 13, control: str | None = CONTROLS["xenium"]) -> DataFrame:
    """Xenium molecules above a quality, with cell and nucleus."""
    return _molecules(df.filter(F.col("qv") > least_quality), "x_location", "y_location", "feature_name", 1.0, ["cell_id", "overlaps_nucleus"], control)


def visium(positions: DataFrame, barcodes: DataFrame, features: DataFrame, matrix: DataFrame, scale: float = 1.0) -> DataFrame:
    """Visium HD squares: barcode places joined with a sparse matrix (gene_idx, barcode_idx, Count), both indices from 1."""
    at = barcodes.join(positions.filter("in_tissue = 1"), "barcode").select("barcode_idx", (F.col("pxl_col_in_fullres") * F.lit(float(scale))).alias("X"), (F.col("pxl_row_in_fullres") * F.lit(float(scale))).alias("Y"))
    return matrix.join(at, "barcode_idx").join(features.select("gene_idx", "gene"), "gene_idx").select("X", "Y", "gene", "Count")


def feature_totals(molecules: DataFrame) -> DataFrame:
    by = ["gene", "transcript_id"] if "transcript_id" in molecules.columns else ["gene"]
    return molecules.groupBy(*by).agg(F.sum("Count").alias("Count"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): the lines of a file, numbered from 1 in file order."""
    lines = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id())
    # Numbers within a partition are consecutive; a partition's first number is the rows of those before it.
    part = F.shiftright("_m", 33)
    sizes = lines.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return lines.withColumn("p", part).join(F.broadcast(before), "p").select((F.col("before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line"), F.col("value").alias("text"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(gene_idx, barcode_idx, Count) of a coordinate matrix; comments and the size line are left out."""
    lines = numbered_lines(spark, path)
    # The size line is the one after the comments, in whichever of the files they are.
    comments = [r.line for r in lines.filter(F.col("text").startswith("%")).select("line").collect()]
    lines = lines.filter(~F.col("text").startswith("%") & ~F.col("line").isin([c + 1 for c in comments]))
    part = F.split("text", r"\s+")
    return lines.select(part[0].cast("long").alias("gene_idx"), part[1].cast("long").alias("barcode_idx"), part[2].cast("double").cast("int").alias("Count"))


def solo(df: DataFrame, counts: str = "counts") -> DataFrame:
    """Barcode tables whose counts are one comma-joined column gn,gt,spl,unspl,ambig."""
    part = F.split(counts, ",")
    return df.select(*[c for c in df.columns if c != counts], *(part[i].cast("int").alias(c) for i, c in enumerate(("gn", "gt", "spl", "unspl", "ambig"))))


# --- models, anchors, results ---


def model(spark: SparkSession, path: str, floor: float = 0.0) -> DataFrame:
    """(gene, factor, lambda) from a matrix of genes by factor columns; values floored for decoding."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tsv(spark, path)
    if {"gene", "factor", "lambda"} <= set(df.columns):
        out = df
    else:
        gene = "gene" if "gene" in df.columns else df.columns[0]
        cols = [c for c in df.columns if c != gene]
        named = factor_columns(cols)
        pairs = named.items() if len(named) == len(cols) else ((str(i), c) for i, c in enumerate(cols))
        pairs = [F.struct(F.lit(int(k)).alias("factor"), F.col(f"`{c}`").cast("double").alias("lambda")) for k, c in pairs]
        out = df.select(F.col(gene).cast("string").alias("gene"), F.inline(F.array(*pairs)))
    return out.withColumn("lambda", F.greatest("lambda", F.lit(float(floor)))) if floor else out


def anchors(spark: SparkSession, path: str, mu_scale: float = 1.0) -> DataFrame:
    """(x, y, theta) of an anchor table with factor columns."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tsv(spark, path)
    df = df.toDF(*(c.lower() if c in "XY" else c for c in df.columns))
    out = theta(df.select("x", "y", *factor_columns(df.columns).values()))
    return micrometres(out, mu_scale, "x", "y") if mu_scale != 1 else out


def _typed(v: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return v


def block_meta(lines: list[str]) -> tuple[dict, list[str]]:
    """(metadata, header) from the ``##key=value;...`` lines and the ``#`` header of a block-indexed file."""
    meta: dict = {}
    header: list[str] = []
    for line in lines:
        if line.startswith("##"):
            meta |= {k: _typed(v) for k, v in (x.split("=", 1) for x in line[2:].strip().split(";") if "=" in x)}
        elif line.startswith("#"):
            header = line[1:].strip().split("\t")
    return meta, header


def _block_kinds(header: list[str]) -> list[tuple[str, str]]:
    return [(c, "long" if c in ("BLOCK", "X", "Y") else "int" if re.match(r"K\d", c) else "double" if re.match(r"P\d", c) else "string") for c in header]


def _blocks_touched(meta: dict, box: tuple[float, float, float, float]) -> tuple[int, int]:
    """The first and last BLOCK that a box (xmin, xmax, ymin, ymax) touches; 0 and -1 if there are no blocks."""
    size, along = float(meta.get("BLOCK_SIZE", 0)), 0 if meta.get("BLOCK_AXIS", "X") == "X" else 2
    off = float(meta.get("OFFSET_Y" if along else "OFFSET_X", 0))
    return tuple(int(max(0, v - off) // size * size) for v in box[along : along + 2]) if size else (0, -1)


def _placed(df: DataFrame, meta: dict, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Scaled integers as micrometres; rows in the box, bounds included."""
    scale, ox, oy = float(meta.get("SCALE", 1)), float(meta.get("OFFSET_X", 0)), float(meta.get("OFFSET_Y", 0))
    df = df.withColumns({"X": F.col("X") / F.lit(scale) + F.lit(ox), "Y": F.col("Y") / F.lit(scale) + F.lit(oy)})
    return df.filter((F.col("X") >= box[0]) & (F.col("X") <= box[1]) & (F.col("Y") >= box[2]) & (F.col("Y") <= box[3])) if box else df


def blocks(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, where: str | None = None) -> tuple[DataFrame, dict]:
    """(rows in micrometres, metadata) of block-indexed results; a box (xmin, xmax, ymin, ymax), bounds included, selects blocks and then rows."""
    lines = [r.value for r in spark.read.text(path).filter(F.col("value").startswith("#")).distinct().collect()]  # four lines, the same in each file
    meta, header = block_meta(lines)
    df = spark.read.option("sep", "\t").option("comment", "#").schema(", ".join(f"`{c}` {k}" for c, k in _block_kinds(header))).csv(path)
    if box:
        lo, hi = _blocks_touched(meta, box)
        df = df.filter(F.col("BLOCK").between(lo, hi)) if hi >= lo else df
    return _placed(df.filter(where) if where else df, meta, box), meta


def block_regions(meta: dict, box: tuple[float, float, float, float]) -> list[tuple[str, int, int]]:
    """The regions (block, least, greatest position) of an index that a box needs."""
    lo, hi = _blocks_touched(meta, box)
    along, off = (2, "OFFSET_Y") if meta.get("BLOCK_AXIS", "X") == "X" else (0, "OFFSET_X")
    ends = [(v - float(meta.get(off, 0))) * float(meta.get("SCALE", 1)) for v in box[along : along + 2]]
    # A scaled place is rounded down, and one below the offset is 0.
    ends = max(0, math.floor(ends[0]) - 1), max(0, math.ceil(ends[1]) + 1)
    return [(str(b), *ends) for b in range(lo, hi + 1, int(meta["BLOCK_SIZE"]))] if hi >= lo else []


def blocks_indexed(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, where: str | None = None) -> tuple[DataFrame, dict]:
    """The same as :func:`blocks` for block-compressed files with an index of positions: only what the box needs is read."""
    meta, header = block_meta(bgzf.head(path))
    rows = bgzf.lines(spark, path, block_regions(meta, box) if box else None)
    df = rows.select(*(F.get("parts", F.lit(i)).cast(k).alias(c) for i, (c, k) in enumerate(_block_kinds(header))))
    return _placed(df.filter(where) if where else df, meta, box), meta


def pixels_indexed(spark: SparkSession, path: str, regions: list[tuple[str, float, float]], mu_scale: float = 1.0, key: str = "Count") -> DataFrame:
    """Pixels of regions (name, from, to) of a block-compressed table with an index; its first line has the names of columns.

    Regions are in the table's own units; positions are then micrometres.
    """
    first = bgzf.head(path)[0]
    header = first.lstrip("#").strip().split("\t")
    rows = bgzf.lines(spark, path, [(n, math.floor(lo), math.ceil(hi)) for n, lo, hi in regions]).filter(F.col("value") != first)
    out = normalised(rows.select(*(F.get("parts", F.lit(i)).alias(c) for i, c in enumerate(header))), "xy")
    kinds = {"X": "double", "Y": "double", key: "int"}
    out = out.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in out.columns))
    return micrometres(out, mu_scale) if mu_scale != 1 else out


def factors(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, indexed: bool = False) -> DataFrame:
    """(x, y, theta) of block-indexed results: the K stored factors of a place as an array of all of them."""
    rows, meta = (blocks_indexed if indexed else blocks)(spark, path, box)
    top = [(f"K{i + 1}", f"P{i + 1}") for i in range(int(meta["TOPK"]))]
    share = lambda f: sum((F.when(F.col(k) == f, F.col(p)).otherwise(0.0) for k, p in top), F.lit(0.0))
    return rows.select(F.col("X").alias("x"), F.col("Y").alias("y"), F.array(*(share(f) for f in range(int(meta["K"])))).alias("theta"))


def curve(spark: SparkSession, path: str, box: tuple[float, float, float, float], cell: float, extent: tuple[float, float, float, float], x: str = "X", y: str = "Y") -> DataFrame:
    """Rows in a box (xmin, xmax, ymin, ymax), bounds included, of a table on a Z curve: its ranges are pushed to the footers of the files.

    ``cell`` and ``extent`` are those that the table was written with.
    """
    top = (1 << binning.CURVE_BITS) - 1
    cells = [min(max(math.floor((v - extent[i // 2 * 2]) / cell), 0), top) for i, v in enumerate(box)]
    df, keep = spark.read.parquet(path), F.lit(False)
    for lo, hi in binning.curve_ranges(tuple(cells)):
        keep = keep | F.col(binning.CURVE).between(lo, hi)
    inside = F.col(x).between(box[0], box[1]) & F.col(y).between(box[2], box[3])
    return df.filter(keep).filter(inside).drop(binning.CURVE)


def lane_regions(df: DataFrame, regions: list[tuple[str, float, float]], lane: str = "lane", y: str = "Y") -> DataFrame:
    """Rows of regions (lane, from, to), bounds included; on a table partitioned by lane this prunes."""
    keep = F.lit(False)
    for name, lo, hi in regions:
        keep = keep | ((F.col(lane) == name) & F.col(y).between(lo, hi))
    return df.filter(keep)


def category_map(spark: SparkSession, path: str) -> DataFrame:
    """(From, To) of a two-column table without a header."""
    return tsv(spark, path, "`From` string, `To` string", header=False)


# --- geometry ---


def polygons(text: str) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a GeoJSON text, each a list of its rings: the outline, then its holes."""

    def found(g: dict) -> list:
        kind = g.get("type")
        if kind in ("FeatureCollection", "GeometryCollection"):
            return [x for part in g["features" if kind == "FeatureCollection" else "geometries"] for x in found(part)]
        if kind == "Feature":
            return found(g["geometry"]) if g.get("geometry") else []
        return {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(kind, lambda c: [])(g.get("coordinates", []))

    def ring(points: list) -> list[tuple[float, float]]:
        out = [(float(x), float(y)) for x, y, *_ in points]
        return out[:-1] if len(out) > 1 and out[0] == out[-1] else out

    return [[ring(r) for r in polygon] for polygon in found(json.loads(text))]


def buffer_of(text: str) -> float:
    """The greatest property ``buffer`` of a boundary file's features, 0 if there is none."""
    if not text.lstrip().startswith("{"):
        return 0.0
    data = json.loads(text)
    return max((float((f.get("properties") or {}).get("buffer") or 0) for f in data.get("features", [data])), default=0.0)


def geojson(text: str) -> list[list[tuple[float, float]]]:
    """The rings of all polygons of a GeoJSON text."""
    return [r for polygon in polygons(text) for r in polygon]


def boundary(text: str) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a boundary file: GeoJSON, or SVG paths, one polygon a line (after a header ``path``, in its last column)."""
    if text.lstrip().startswith("{"):
        return polygons(text)
    lines = [x.split("\t")[-1] for x in text.splitlines() if x.strip()]
    return [svg_path(x) for x in (lines[1:] if lines and lines[0].strip() == "path" else lines)]


def svg_path(text: str, steps: int = 8) -> list[list[tuple[float, float]]]:
    """The rings of an SVG path with M, L, Q, C and Z in absolute or relative form; curves become chords. Text is only tokenised."""
    tokens = re.findall(r"[MLQCZmlqcz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)
    out: list[list[tuple[float, float]]] = []
    ring: list[tuple[float, float]] = []
    at, command, i = (0.0, 0.0), "", 0

    def take(n: int) -> list[tuple[float, float]]:
        nonlocal i
        v = [float(x) for x in tokens[i : i + 2 * n]]
        i += 2 * n
        base = at if command.islower() else (0.0, 0.0)
        return [(base[0] + a, base[1] + b) for a, b in zip(v[::2], v[1::2])]

    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
        if command in "Zz":
            if ring:
                out.append(ring)
            at, ring = (ring[0] if ring else at), []
            continue
        if command in "Mm":
            if ring:
                out.append(ring)
            ring = take(1)
            at = ring[0]
            command = "l" if command == "m" else "L"
        elif command in "Ll":
            ring += take(1)
        else:
            control = [at, *take(2 if command in "Qq" else 3)]
            for s in range(1, steps + 1):
                t, p = s / steps, control
                while len(p) > 1:
                    p = [((1 - t) * a + t * c, (1 - t) * b + t * d) for (a, b), (c, d) in zip(p, p[1:])]
                ring.append(p[0])
        at = ring[-1] if ring else at
    return [*out, ring] if ring else out


def scaled(rings: list[list[tuple[float, float]]], unit: float = 1.0, dx: float = 0.0, dy: float = 0.0, transpose: bool = False) -> list[list[tuple[float, float]]]:
    """Rings in other units, moved, and with the axes exchanged."""
    moved = [[((x + dx) * unit, (y + dy) * unit) for x, y in r] for r in rings]
    return [[(y, x) for x, y in r] for r in moved] if transpose else moved


EDGES = "x1 double, y1 double, x2 double, y2 double"


def edges(spark: SparkSession, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """(x1, y1, x2, y2) of all edges of one polygon's rings."""
    return polygon_edges(spark, [rings]).drop("polygon")


def polygon_edges(spark: SparkSession, shapes: list[list[list[tuple[float, float]]]]) -> DataFrame:
    """(x1, y1, x2, y2, polygon) of all edges of polygons."""
    rows = [(*map(float, (*a, *b)), i) for i, rings in enumerate(shapes) for r in rings for a, b in zip(r, r[1:] + r[:1])]
    return spark.createDataFrame(rows, EDGES + ", polygon int")


# --- images ---


def tiff_extent(file) -> dict[str, float]:
    """width and height in pixels of a TIFF's first image, and xmax and ymax in micrometres if an OME description gives pixel sizes.

    ``file`` is the bytes of the file, or an open one, of which the tags alone are read.
    """
    file = io.BytesIO(file) if isinstance(file, bytes) else file

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    head = at(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("no classic TIFF")
    first = struct.unpack(order + "I", head[4:8])[0]
    tags = {}
    entries = at(first + 2, 12 * struct.unpack(order + "H", at(first, 2))[0])
    for i in range(0, len(entries), 12):
        tag, kind, n = struct.unpack(order + "HHI", entries[i : i + 8])
        if tag in (256, 257):
            tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entries[i + 8 : i + (10 if kind == 3 else 12)])[0]
        elif tag == 270:
            start = struct.unpack(order + "I", entries[i + 8 : i + 12])[0]
            tags[tag] = at(start, n).decode("utf-8", "replace") if n > 4 else ""
    out = {"width": float(tags[256]), "height": float(tags[257])}
    for axis, size in (("X", "width"), ("Y", "height")):
        found = re.search(rf'PhysicalSize{axis}="([0-9.eE+-]+)"', tags.get(270, ""))
        if found:
            out[f"{axis.lower()}max"] = out[size] * float(found[1])
    return out


def image_box(spark: SparkSession, path: str) -> DataFrame:
    """One row (xmin, xmax, ymin, ymax) of an image's extent: micrometres if it has pixel sizes, and else pixels."""
    with bgzf.opened(path) as f:
        e = tiff_extent(f)
    return spark.createDataFrame([(0.0, e.get("xmax", e["width"]), 0.0, e.get("ymax", e["height"]))], "xmin double, xmax double, ymin double, ymax double")


# --- chip layout ---


def layout(tiles: DataFrame, ranges: DataFrame) -> DataFrame:
    """Layout (lane, tile, row, col) with each tile's range and its shift within the grid."""
    both = tiles.join(ranges, ["lane", "tile"], "left")
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    width, height = F.max(h).over(Window.partitionBy("lane", "row")), F.max(w).over(Window.partitionBy("lane", "col"))
    return both.withColumns({"row_height": width, "col_width": height})
