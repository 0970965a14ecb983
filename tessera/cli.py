"""Command line: ``python -m tessera VERB --option value``; each verb reads tables and writes tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import hexgrid
from tessera.functions.colours import from_hex, to_bytes
from tessera.functions.vectors import posterior_counts, with_top
from tessera.operators import binning, filters, markers, rasters, regions, spatial
from tessera.operators.decode import decode
from tessera.operators.lda import Lda
from tessera.plans import workflow
from tessera.sources import bgzf, images, readers, sinks

#: What all raster images can be shown by: corner of the origin, exchanged axes, a box.
VIEW = {"origin": "upper", "transpose": False, "xmin": "", "xmax": "", "ymin": "", "ymax": ""}
OPTIONS = {
    "filter_by_density": {"radius": 15.0, "n_move": 2, "quartile": 2, "least": 0.02, "least_dense": 0.1, "outlines": False},
    "filter_by_density_windows": {"width": 24.0, "n_move": 2, "least": 0.02, "least_dense": 0.1, "windows": 1, "axis": "Y", "precision": 0.0, "hard": 0.0},
    "filter_by_boundary": {"boundary": "", "unit": 1.0, "dx": 0.0, "dy": 0.0, "transpose": False, "buffer": -1.0},
    "make_spatial_minibatch": {"batch_size": 500.0, "batch_buff": 50.0, "mu_scale": 26.67, "min_pixel": 100, "region": "", "region_um": ""},
    "make_dge": {"n_move": 3, "hex_width": 24.0, "min_ct": 20.0, "density": 0.2, "key": "Count", "mu_scale": 1.0, "boundary": "", "buffer": -1.0, "group_within": "", "debug": 0, "axis": "X", "untrimmed": False},
    "make_sge_by_hexagon": {"hex_width": 24.0, "n_move": 1, "density": 0.1, "key": "Count", "boundary": "", "buffer": -1.0, "overlap": 0.0},
    "fit_model": {"norm": "none", "by_epoch": False, "alpha": 1.0, "tau": 9.0, "kappa": 0.7, "n_factor": 12, "restarts": 5, "epochs": 1, "train": 0.5, "min_ct_unit": 50, "min_ct_feature": 50, "seed": 0},
    "lda": {"n_factor": 10, "prior": "", "rescale": 0.0, "total": 1e4, "shift_log": False, "scale": 0.0, "epochs": 1, "epoch_length": 0, "min_ct_feature": 1, "min_ct_unit": 20, "alpha": 1.0, "tau": 9.0, "kappa": 0.7, "seed": 0},
    "impute": {"decoded": "", "radius": 5.0, "k": 1, "halflife": 0.7, "include_self": False, "sparsify": 0.0, "indexed": False},
    "transform": {"model": "", "norm": "none", "n_move": 3, "hex_width": 24.0, "min_ct": 20.0, "precision": 1, "axis": "X", "untrimmed": False},
    "slda_decode": {"model": "", "anchors": "", "radius": 25.0, "halflife": 0.7, "side": 500.0, "halo": 50.0, "share": 0.2, "top": 3, "most": 0, "precision": 0.1},
    "de_bulk": {"min_ct": 50.0, "p": 1e-3, "fold": 1.5, "min_output": 10},
    "factor_report": {"markers": "", "colours": "", "annotation": "", "n_top": 20, "min_top": 10},
    "choose_color": {"n_factor": 12, "width": 24.0, "n_move": 1, "seed": 0, "circle": False, "even": False, "top_color": "#fcd217"},
    "plot_base": {"colours": "", "um": 1.0, "fill": 0, "top_image": False, "by_factor": False, "category": "", "names": "", **VIEW},
    "plot_hexagon": {"colours": "", "um": 1.0, "width": 24.0, **VIEW},
    "plot_pixel_full": {"colours": "", "um": 1.0, "top": 3, "top_only": False, "category": "", "names": "", "background": "#000000", **VIEW},
    "plot_pixel_multi": {"channels": "", "um": 1.0, "top": 3, "cut": 0.1, "colours": "", **VIEW},
    "plot_pixel_single": {"n_factor": 12, "um": 1.0, "top": 3, "least": 100, "factors": "", **VIEW},
    "plot_boundary": {"unit": 1.0, "dx": 0.0, "dy": 0.0, "um": 1.0, "ink": "#ffffff", "transpose": False},
    "block_index": {"indexed": False, "n_factor": 12, "top": 3, "block": 2000.0, "scale": 100.0, "off_x": 0.0, "off_y": 0.0},
    "format": {"platform": "xenium", "scale": 0.12, "quality": 13.0, "positions": "", "barcodes": "", "features": "", "image": ""},
    "init_model_from_pseudobulk": {"model": "", "epochs": 0, "scale": 0.0, "reorder": False, "min_ct_unit": 50, "min_ct_feature": 50},
    "run_together": {"train_widths": "12", "n_factors": "12", "restarts": 10, "epochs": 3, "n_move": 2, "top": 3, "dry_run": False, "jobs": 1},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, options in OPTIONS.items():
        v = verbs.add_parser(verb)
        v.add_argument("--input", required=True)
        v.add_argument("--output", required=True)
        for name, default in options.items():
            flag = f"--{name.replace('_', '-')}"
            v.add_argument(flag, action="store_true") if default is False else v.add_argument(flag, type=type(default), default=default)
    return p


def boxed(df, a: argparse.Namespace, x: str, y: str):
    """Rows in the box of the options that are given."""
    for name, c, low in (("xmin", x, True), ("xmax", x, False), ("ymin", y, True), ("ymax", y, False)):
        if getattr(a, name) != "":
            end = float(getattr(a, name))
            df = df.filter(F.col(c) >= end if low else F.col(c) <= end)
    return df


def painted(spark: SparkSession, a: argparse.Namespace, cells, path: str) -> None:
    """One image of cells (px, py, r, g, b), a PNG or by its name a TIFF."""
    images.write(cells, path, from_hex(getattr(a, "background", "#000000")), a.origin, a.transpose)


def category_cells(spark: SparkSession, a: argparse.Namespace, df, colours, x: str, y: str):
    """Cells in the colours of their most frequent category, renamed by a map if there is one."""
    names = readers.category_map(spark, a.names) if a.names else None
    by = rasters.categories(df, a.um, a.category, names, x, y)
    return rasters.with_colours(by, colours, "category").select("px", "py", *(F.col(c).alias(c.lower()) for c in "RGB"))


def shapes_of(spark: SparkSession, path: str, unit: float = 1.0, dx: float = 0.0, dy: float = 0.0, transpose: bool = False) -> tuple[list, float]:
    """(polygons, buffer) of a boundary file, coordinates times ``unit`` and then moved."""
    text = readers.text_of(spark, path)
    return [readers.scaled(r, unit, dx / unit, dy / unit, transpose) for r in readers.boundary(text)], readers.buffer_of(text) * unit


def in_boundary(df, a: argparse.Namespace, x: str = "X", y: str = "Y", **moved):
    """Rows in a boundary file's polygons, or within the buffer that the file or the options name."""
    shapes, buffer = shapes_of(df.sparkSession, a.boundary, **moved)
    edges = readers.polygon_edges(df.sparkSession, shapes)
    return spatial.within_buffered(df, edges, a.buffer if a.buffer >= 0 else buffer, x, y)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    save = lambda df, name="": df.write.mode("overwrite").parquet(f"{a.output}{name}")
    read = lambda path: spark.read.parquet(path)
    if a.verb == "filter_by_density":
        kept, totals, cut = regions.filter_by_density(readers.pixels(spark, a.input), radius=a.radius, n_move=a.n_move, quartile=a.quartile, least=a.least, least_dense=a.least_dense)
        save(kept, "/pixels"), save(totals, "/features")
        sinks.write_bytes(spark, f"{a.output}/cutoffs.json", json.dumps(cut.__dict__).encode())
        if a.outlines:
            for name, tri in zip(("lenient", "strict"), regions.dense_triangles(readers.pixels(spark, a.input), cut, radius=a.radius, n_move=a.n_move, least=a.least)):
                sinks.write_bytes(spark, f"{a.output}/{name}.geojson", sinks.geojson(regions.outline(tri), a.radius).encode())
    elif a.verb == "filter_by_density_windows":
        save(regions.filter_by_anchors(readers.pixels(spark, a.input), a.width, a.n_move, a.least, least_dense=a.least_dense, windows=a.windows, axis=a.axis, precision=a.precision, hard=a.hard))
    elif a.verb == "filter_by_boundary":
        save(in_boundary(readers.pixels(spark, a.input), a, unit=a.unit, dx=a.dx, dy=a.dy, transpose=a.transpose))
    elif a.verb == "make_spatial_minibatch":
        if a.region or a.region_um:  # parts of a block-compressed table, by its index
            ask = [(n, lo, hi) for n, lo, hi in bgzf.regions_of(a.region)] + [(n, lo * a.mu_scale, hi * a.mu_scale) for n, lo, hi in bgzf.regions_of(a.region_um)]
            p = readers.pixels_indexed(spark, a.input, ask)
        else:
            p = readers.pixels(spark, a.input)
        save(binning.tiled(p, a.batch_size * a.mu_scale, a.batch_buff * a.mu_scale, a.min_pixel))
    elif a.verb == "make_dge":
        groups = tuple(x for x in a.group_within.split(",") if x)
        p = filters.limited(readers.pixels(spark, a.input, a.key, a.mu_scale, keep=groups), a.debug)
        out = binning.centred(binning.dge(p, a.hex_width, a.n_move, a.key, groups=groups, min_ct=a.min_ct, density=a.density), a.hex_width, a.n_move)
        out = in_boundary(out, a, "x", "y") if a.boundary else out
        if not a.untrimmed:  # cells at both ends of the axis are not whole
            inner = binning.edge_trimmed(p, binning.hexed(p, a.hex_width, a.n_move), a.hex_width, a.axis, groups)
            out = out.join(inner, [*groups, *binning.HEX], "left_semi")
        save(out.withColumn("unit", binning.unit_id(*groups, *binning.HEX)))
    elif a.verb == "make_sge_by_hexagon":
        p, moves = readers.pixels(spark, a.input, a.key), binning.moves_for_overlap(a.overlap) if a.overlap else a.n_move
        cells = binning.hex_units(p, a.hex_width, moves, a.key, min_ct=0, density=a.density, centre="mean").select(*binning.HEX, "x", "y")
        cells = in_boundary(cells, a, "x", "y") if a.boundary else cells
        sinks.write_matrix(binning.dge(p, a.hex_width, moves, a.key, min_ct=0, density=a.density).join(cells, binning.HEX), p, a.output)
    elif a.verb == "fit_model":
        o = workflow.DEFAULTS | {k: getattr(a, k) for k in ("restarts", "epochs", "train", "min_ct_unit", "min_ct_feature", "seed", "norm", "by_epoch", "alpha", "tau", "kappa")}
        model, scores = workflow.fit(read(a.input).select("unit", "gene", F.col("n").cast("double").alias("n")), a.n_factor, o)
        model.save(spark, f"{a.output}/model")
        save(scores, "/coherence")
    elif a.verb == "lda":
        counts = read(a.input).select("unit", "gene", F.col("n").cast("double").alias("n"))
        model, theta = workflow.fit_from_prior(counts, a.n_factor, {k: getattr(a, k) for k in OPTIONS["lda"] if k not in ("n_factor", "prior")}, readers.model(spark, a.prior) if a.prior else None)
        model.save(spark, f"{a.output}/model")
        save(theta, "/theta")
    elif a.verb == "impute":
        p = readers.pixels(spark, a.input).select("X", "Y").distinct().withColumn("at", F.struct("X", "Y"))
        got = spatial.factor_lookup(p, readers.factors(spark, a.decoded, indexed=a.indexed), "at", a.radius, a.k, a.halflife, a.include_self, a.sparsify)
        save(with_top(got.select("at.*", "theta"), 3))
    elif a.verb == "transform":
        p = readers.pixels(spark, a.input)
        counts = workflow.counts_of(p, a.hex_width, a.n_move, a.min_ct)
        counts = counts if a.untrimmed else binning.centre_trimmed(counts, p, a.hex_width, a.axis)
        counts = counts.withColumns({c: F.round(c, a.precision) for c in "xy"}) if a.precision >= 0 else counts
        theta = workflow.transform(Lda.load(spark, a.model), counts, spark, a.min_ct, a.norm)
        save(theta, "/anchors")
        save(posterior_counts(theta.select("unit", "theta"), counts), "/posterior")
    elif a.verb == "slda_decode":
        p = readers.pixels(spark, a.input)
        # Places are summed by the decoder; adaptive tiles count rows by place and gene.
        p = (binning.collapsed_truncating if a.most else binning.truncated)(p, a.precision) if a.precision > 0 else p
        got = decode(p, read(a.anchors).select("x", "y", "theta"), Lda.load(spark, a.model).matrix(spark), a.side, a.halo, a.radius, a.halflife, a.share, most=a.most)
        save(with_top(got, a.top))
    elif a.verb == "de_bulk":
        save(markers.with_pvalues(markers.ranked(markers.chi_square(read(a.input), a.min_ct), a.p, a.fold, a.min_output)))
    elif a.verb == "factor_report":
        counts = read(a.input)
        table = markers.factor_table(counts, read(a.markers), a.n_top, min_top=a.min_top)
        save(table, "/table")
        names = {r["From"]: r["To"] for r in readers.category_map(spark, a.annotation).collect()} if a.annotation else {}
        rgb = {str(r.Name): ",".join(str(int(v)) for v in to_bytes([r.R, r.G, r.B])) for r in read(a.colours).collect()} if a.colours else {}
        rows = [{"factor": names.get(r.factor, r.factor)} | ({"RGB": rgb.get(r.factor, "128,128,128")} if rgb else {}) | {k: v for k, v in r.asDict().items() if k != "factor"} for r in table.orderBy(F.desc("weight")).collect()]
        tree = markers.factor_tree(counts, names)
        sinks.write_bytes(spark, f"{a.output}/tree.nwk", tree.encode())
        sinks.write_bytes(spark, f"{a.output}/report.html", sinks.report(rows, newick=tree).encode())
    elif a.verb == "choose_color":
        save(spark.createDataFrame(workflow.factor_colours(read(a.input), a.n_factor, a.width, a.n_move, a.seed, a.circle, a.even, a.top_color), "Name string, Color_index int, R double, G double, B double"))
    elif a.verb in ("plot_base", "plot_hexagon", "plot_pixel_full"):
        colours, (x, y) = read(a.colours), ("X", "Y") if a.verb == "plot_pixel_full" else ("x", "y")
        shown = boxed(read(a.input), a, x, y)
        if getattr(a, "category", ""):
            painted(spark, a, category_cells(spark, a, shown, colours, x, y), a.output)
            return
        colours = colours.withColumn("factor", F.col("Name").cast("int"))
        if a.verb == "plot_pixel_full":
            if a.top_only:
                shown = shown.withColumn("P1", F.lit(1.0))
            cells = rasters.top_rgb(shown, a.um, colours, 1 if a.top_only else a.top)
        elif a.verb == "plot_hexagon":
            edge = shown.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
            ends = [[int(edge[i] / a.um) - 1, int(edge[i + 1] / a.um) + 1] for i in (0, 2)]
            grid = spark.range(ends[0][0], ends[0][1] + 1).select(F.col("id").alias("px"), F.explode(F.sequence(*(F.lit(v).cast("long") for v in ends[1]))).alias("py"))
            known = shown.withColumn("_h", hexgrid.pixel_to_hex(F.col("x"), F.col("y"), hexgrid.radius_of(a.width))).select(F.col("_h.hx").alias("hx"), F.col("_h.hy").alias("hy"), "theta")
            cells = rasters.mixed(rasters.hexagon_cells(known, grid, a.um, a.width).select("px", "py", F.posexplode("theta").alias("factor", "p")), colours)
        else:
            means = rasters.mean_values(shown, a.um).persist()
            if a.top_image:
                top = rasters.top_cells(means).withColumn("p", F.lit(1.0))
                painted(spark, a, rasters.mixed(top, colours), f"{a.output}.top.png")
            if a.by_factor:
                for r in means.select("factor").distinct().collect():  # one image a factor
                    one = means.filter(F.col("factor") == r.factor).select("px", "py", *(F.col("p").alias(c) for c in "rgb"))
                    painted(spark, a, one, f"{a.output}.factor_{r.factor}.png")
            cells = rasters.mixed(means, colours).withColumn("rgb", F.array("r", "g", "b"))
            if a.fill:
                box = cells.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
                grid = spark.range(box[0], box[1] + 1).select(F.col("id").alias("px"), F.explode(F.sequence(F.lit(box[2]), F.lit(box[3]))).alias("py"))
                cells = rasters.filled(grid, cells.select("px", "py", "rgb"), a.fill, "rgb")
            cells = cells.select("px", "py", *(F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")))
        painted(spark, a, cells, a.output)
    elif a.verb == "plot_pixel_multi":
        # A factor without a colour of its own has that of the table.
        table = {str(r.Name): (r.R, r.G, r.B) for r in read(a.colours).collect()} if a.colours else {}
        chosen = [(int(k), from_hex(c) if c else table[k]) for k, _, c in (x.partition(":") for x in a.channels.split(","))]
        painted(spark, a, rasters.channels(boxed(read(a.input), a, "X", "Y"), a.um, chosen, a.top, a.cut), a.output)
    elif a.verb == "plot_pixel_single":
        maps = rasters.single_factors(boxed(read(a.input), a, "X", "Y"), a.um, a.n_factor, a.top, a.least)
        maps = (maps.filter(F.col("factor").isin([int(x) for x in a.factors.split(",")])) if a.factors else maps).persist()
        for r in maps.select("factor").distinct().collect():  # one image a factor
            painted(spark, a, maps.filter(F.col("factor") == r.factor).select("px", "py", *(F.col("p").alias(c) for c in "rgb")), f"{a.output}/factor_{r.factor}.png")
    elif a.verb == "plot_boundary":
        rings = [r for shape in shapes_of(spark, a.input, a.unit, a.dx, a.dy, a.transpose)[0] for r in shape]
        sinks.write_bytes(spark, a.output, sinks.png(rasters.outlines(rings, a.um, tuple(int(255 * c) for c in from_hex(a.ink)))))
    elif a.verb == "block_index":
        (sinks.write_blocks_indexed if a.indexed else sinks.write_blocks)(read(a.input), a.output, a.n_factor, a.top, a.block, a.scale, a.off_x, a.off_y)
    elif a.verb == "format":
        table = lambda path: spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
        if a.platform == "visium":  # the input is the matrix, its names are lists without a header
            names = [readers.numbered_lines(spark, x) for x in (a.barcodes, a.features)]
            barcodes = names[0].select(F.col("line").alias("barcode_idx"), F.trim("text").alias("barcode"))
            part = F.split("text", "\t")
            features = names[1].select(F.col("line").alias("gene_idx"), F.coalesce(F.get(part, F.lit(1)), F.get(part, F.lit(0))).alias("gene"))
            made = readers.visium(table(a.positions), barcodes, features, readers.matrix_market(spark, a.input), a.scale)
        else:
            made = {"cosmx": lambda r: readers.cosmx(r, a.scale), "vizgen": readers.vizgen, "xenium": lambda r: readers.xenium(r, a.quality)}[a.platform](table(a.input))
        save(made, "/pixels"), save(readers.feature_totals(made), "/features"), save(readers.image_box(spark, a.image) if a.image else binning.bounding_box(made), "/bbox")
    elif a.verb == "init_model_from_pseudobulk":
        counts = read(a.input).select("unit", "gene", F.col("n").cast("double").alias("n"))
        model, theta, post = workflow.from_pseudobulk_counts(readers.model(spark, a.model), counts, a.epochs, a.scale, a.min_ct_feature, a.min_ct_unit, a.reorder)
        model.save(spark, f"{a.output}/model")
        save(theta, "/theta"), save(post, "/posterior")
    elif a.verb == "run_together":
        widths, factors = [float(x) for x in a.train_widths.split(",")], [int(x) for x in a.n_factors.split(",")]
        g = workflow.graph(spark, a.input, a.output, train_widths=widths, n_factors=factors, restarts=a.restarts, epochs=a.epochs, n_move=a.n_move, top=a.top)
        if a.dry_run:
            print(g.describe())
        else:
            g.run(done=lambda t: workflow.exists(spark, t), jobs=a.jobs)
