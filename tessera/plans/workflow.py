"""The whole analysis: pixels to tiles and hexagons, models, decoded pixels, markers, colours, images and report."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import colours
from tessera.functions.vectors import argmax, long, posterior_counts, with_top
from tessera.operators import binning, markers, matrix, rasters
from tessera.operators.decode import decode, pixel_posterior_counts
from tessera.operators.lda import Lda, from_pseudobulk, restarts
from tessera.operators.spatial import on_lattice, proximity
from tessera.plans.stages import Graph
from tessera.sources import images, readers, sinks

#: Defaults of the whole run.
DEFAULTS = {"train_widths": [12.0], "n_factors": [12], "fit_width": None, "anchor_res": 4.0, "n_move": 2, "restarts": 10, "epochs": 3, "top": 3, "min_ct_unit": 50, "min_ct_feature": 50, "radius": 25.0, "side": 500.0, "halo": 50.0, "train": 0.5, "um": 1.0, "seed": 0}


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def counts_of(pixels: DataFrame, width: float, n_move: int, min_ct: float) -> DataFrame:
    """Long units: unit, gene, n, with the cell's centre."""
    out = binning.centred(binning.dge(pixels, width, n_move, min_ct=min_ct), width, n_move)
    return out.select(binning.unit_id().alias("unit"), "gene", F.col("n").cast("double").alias("n"), "x", "y")


def model_units(counts: DataFrame, index: DataFrame, min_ct: float, norm: str = "none") -> DataFrame:
    """Packed units with enough counts of the indexed genes; ``norm`` is none, log (by the unit's sum) or size (by its size factor)."""
    if norm == "none":
        return matrix.units(counts, index, min_ct)
    known = counts.join(index.select("gene"), "gene", "left_semi")
    enough = known.groupBy("unit").agg(F.sum("n").alias("s")).filter(F.col("s") >= min_ct).select("unit")
    x = matrix.log_normalised(known.join(enough, "unit", "left_semi").select("unit", "gene", "n"), norm == "size")
    return matrix.units(x.withColumnRenamed("x", "n"), index, 0)


def fit(counts: DataFrame, k: int, o: dict) -> tuple[Lda, DataFrame]:
    """(model, coherence): restarts on a share of the units, then more epochs with the best.

    A unit's epoch is the first two characters of its id, the lattice offset:
    one epoch is one pass over the tissue. Restarts take the first epoch, and
    further ones go on with the others in turn; the first is taken up where the
    restarts left it, with the share that they held back.
    """
    o = DEFAULTS | {"norm": "none", "by_epoch": False, "alpha": 1.0, "tau": 9.0, "kappa": 0.7} | o
    index = matrix.features(counts, o["min_ct_feature"]).persist()
    genes = [r.gene for r in index.orderBy("idx").select("gene").collect()]  # some tens of thousands of names
    units = model_units(counts, index, o["min_ct_unit"], o["norm"]).persist()
    if not o["by_epoch"]:
        model, scores = restarts(units, counts, genes, k, o["restarts"], o["train"], 1, o["seed"], alpha=o["alpha"], tau=o["tau"], kappa=o["kappa"])
        return model.fit(units, o["epochs"]).relabelled(), scores
    marked = matrix.epochs(units)
    passes = [r.epoch for r in marked.select("epoch").distinct().orderBy("epoch").collect()]  # one a lattice offset
    first = marked.filter(F.col("epoch") == passes[0]).drop("epoch").persist()
    model, scores = restarts(first, counts, genes, k, o["restarts"], o["train"], 1, o["seed"], alpha=o["alpha"], tau=o["tau"], kappa=o["kappa"])
    done, at = 0.0, 0
    while done < o["epochs"]:
        part = first if at == 0 else marked.filter(F.col("epoch") == passes[at]).drop("epoch")
        share = min(1 - o["train"] if done == 0 else 1.0, o["epochs"] - done)
        model.fit(part, share)
        done, at = done + share, (at + 1) % len(passes)
    return model.relabelled(), scores


def fit_from_prior(counts: DataFrame, k: int, o: dict, prior: DataFrame | None = None) -> tuple[Lda, DataFrame]:
    """(model, theta): one fit over all units, from a table (gene, factor, lambda) of Dirichlet parameters if there is one.

    The prior's factors and those of its genes that have enough counts make the
    model; ``rescale`` makes its weights sum to that share of ``total`` units.
    With ``shift_log`` units are logarithms of their shares, over ``scale`` or else
    over the logarithm of one count in a unit of the 98 % quantile. ``epoch_length``
    characters of a unit's id are its epoch, and the first ``epochs`` of these are seen.
    """
    o = {"min_ct_feature": 1, "min_ct_unit": 20, "epochs": 1, "alpha": 1.0, "tau": 9.0, "kappa": 0.7, "seed": 0, "total": 1e4, "rescale": 0.0, "shift_log": False, "scale": 0.0, "epoch_length": 0} | o
    spark = counts.sparkSession
    genes = [r.gene for r in matrix.features(counts, o["min_ct_feature"]).orderBy("idx").select("gene").collect()]
    lam = None
    if prior is not None:
        wide = prior.toPandas().pivot_table(index="gene", columns="factor", values="lambda", aggfunc="sum", fill_value=0.0)  # as large as a model
        genes = [g for g in genes if g in wide.index]
        lam = wide.loc[genes].to_numpy(float).T
        k = len(lam)
        if o["rescale"] > 0:
            lam *= o["total"] * o["rescale"] / lam.sum()
    model = Lda(genes, k, alpha=o["alpha"], tau=o["tau"], kappa=o["kappa"], seed=o["seed"], lam=lam)
    index = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, idx int")
    if o["shift_log"]:
        known = counts.join(index.select("gene"), "gene", "left_semi")
        enough = known.groupBy("unit").agg(F.sum("n").alias("s")).filter(F.col("s") >= o["min_ct_unit"]).select("unit")
        shares = matrix.log_normalised(known.join(enough, "unit", "left_semi").select("unit", "gene", "n"), q=0.98, scale=o["scale"])
        units = matrix.units(shares.withColumnRenamed("x", "n"), index, 0).persist()
    else:
        units = matrix.units(counts, index, o["min_ct_unit"]).persist()
    if o["epoch_length"] > 0:
        marked = matrix.epochs(units, length=o["epoch_length"])
        for r in marked.select("epoch").distinct().orderBy("epoch").limit(o["epochs"]).collect():  # one a pass over the tissue
            model.fit(marked.filter(F.col("epoch") == r.epoch).drop("epoch"), total=o["total"])
    else:
        model.fit(units, o["epochs"], total=o["total"])
    model = model.relabelled()
    return model, model.transform(units)


def from_pseudobulk_counts(model: DataFrame, counts: DataFrame, epochs: int = 0, scale: float = 0.0, min_ct_feature: float = 50, min_ct_unit: float = 50, reorder: bool = False, seed: int = 0) -> tuple[Lda, DataFrame, DataFrame]:
    """(model, theta, posterior counts) from a pseudobulk table (gene, factor, lambda).

    Genes of the counts that the model lacks take no part in inference, but have
    posterior counts; ``reorder`` numbers factors by their posterior counts.
    """
    spark = counts.sparkSession
    index = matrix.features(counts, min_ct_feature).persist()
    known = [r.gene for r in index.orderBy("idx").select("gene").collect()]
    in_model = counts.join(model.select(F.col("gene").cast("string").alias("gene")).distinct(), "gene", "left_semi")
    total = in_model.agg(F.sum("n")).first()[0] or 0.0
    start = from_pseudobulk(model, known, scale=scale, total=total, seed=seed)
    kept = spark.createDataFrame([(g, i) for i, g in enumerate(start.genes)], "gene string, idx int")
    units = matrix.units(counts, kept, min_ct_unit).persist()
    start = start.fit(units, epochs) if epochs else start
    all_genes = counts.join(index.select("gene"), "gene", "left_semi").select("unit", "gene", "n")
    if reorder:
        mass = posterior_counts(start.transform(units), all_genes).groupBy("factor").agg(F.sum("cnt").alias("c")).toPandas()  # one row a factor
        weight = np.zeros(start.k)
        weight[mass.factor.to_numpy(int)] = mass.c.to_numpy(float)
        start.lam = start.lam[np.argsort(-weight, kind="stable")]
    theta = start.transform(units)
    return start, theta, posterior_counts(theta, all_genes)


def transform(model: Lda, counts: DataFrame, spark: SparkSession, min_ct: float = 20, norm: str = "none") -> DataFrame:
    """(unit, x, y, topK, topP, theta) of units with counts of the model's genes."""
    index = spark.createDataFrame([(str(g), i) for i, g in enumerate(model.genes)], "gene string, idx int")
    units = model_units(counts, index, min_ct, norm)
    at = counts.groupBy("unit").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    return model.transform(units).join(at, "unit").select("unit", "x", "y", argmax(F.col("theta")).alias("topK"), F.array_max("theta").alias("topP"), "theta")


def factor_colours(anchors: DataFrame, k: int, width: float, n_move: int, seed: int = 0, circle: bool = False, even: bool = False, top: str = colours.TOP, names: list[str] | None = None) -> list[tuple]:
    """Colours for factors from the neighbourhood of anchors: only K x K sums come to the driver. ``even``: the same share of the map for each factor."""
    anchors = anchors.select("unit", "x", "y", "theta").persist()
    near = on_lattice(anchors, "unit", width / n_move)
    w = proximity(near, anchors.select("unit", "theta"), "unit").toPandas()
    sums = np.zeros((k, k))
    sums[w.a.to_numpy(int), w.b.to_numpy(int)] = w.w.to_numpy(float)
    mass = long(anchors.select("theta")).groupBy("factor").agg(F.sum("p").alias("p")).toPandas()
    weight = np.full(k, 1e-9)
    weight[mass.factor.to_numpy(int)] += mass.p.to_numpy(float)
    anchors.unpersist()
    return colours.table(colours.places(colours.similarity(sums), None if even else colours.abundance(weight), top, circle, seed), names)


def graph(spark: SparkSession, pixels_path: str, out: str, **options) -> Graph:
    """The stage graph of a run over a pixel table; results are Parquet tables and small files below ``out``."""
    o = DEFAULTS | options
    g = Graph()
    read = spark.read.parquet

    def pixels() -> DataFrame:
        return readers.pixels(spark, pixels_path)

    def save(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    box = f"{out}/bbox"
    g.add(box, [pixels_path], lambda: save(binning.bounding_box(pixels()), box), "extent")
    for width in o["train_widths"]:
        hexes = f"{out}/hexagon.d_{width:g}"
        g.add(hexes, [pixels_path], lambda w=width, p=hexes: save(counts_of(pixels(), w, o["n_move"], 0), p), "hexagon counts")
        for k in o["n_factors"]:
            name = f"{out}/nF{k}.d_{width:g}"
            model = f"{name}/model"

            def train(p=hexes, k=k, m=model, n=name) -> None:
                best, scores = fit(read(p), k, o)
                best.save(spark, m)
                save(scores, f"{n}/coherence")

            g.add(model, [hexes], train, "model")
            anchor_width = o["fit_width"] or width
            anchors, decoded = f"{name}/anchors", f"{name}/pixels"
            moves = max(1, round(anchor_width / o["anchor_res"]))

            def project(m=model, a=anchors, w=anchor_width, n=moves) -> None:
                save(transform(Lda.load(spark, m), counts_of(pixels(), w, n, 20), spark), a)

            def run_decode(m=model, a=anchors, d=decoded, k=k) -> None:
                got = decode(pixels(), read(a).select("x", "y", "theta"), Lda.load(spark, m).matrix(spark), o["side"], o["halo"], o["radius"])
                save(with_top(got, min(o["top"], k)), d)

            def post(d=decoded, n=name) -> None:
                save(pixel_posterior_counts(read(d).select("X", "Y", "theta"), pixels()), f"{n}/posterior")

            def test(n=name) -> None:
                save(markers.chi_square(read(f"{n}/posterior").withColumnRenamed("cnt", "n")), f"{n}/markers")

            def paint(a=anchors, n=name, k=k, w=anchor_width, mv=moves) -> None:
                rows = factor_colours(read(a), k, w, mv, o["seed"])
                save(spark.createDataFrame(rows, "Name string, Color_index int, R double, G double, B double"), f"{n}/colours")

            def draw(d=decoded, n=name, k=k) -> None:
                c = read(f"{n}/colours").withColumn("factor", F.col("Name").cast("int"))
                cells = rasters.top_rgb(read(d), o["um"], c, min(o["top"], k))
                images.write(cells, f"{n}/pixels.png")

            def tell(n=name) -> None:
                rgb = {r.Name: ",".join(str(int(v)) for v in colours.to_bytes([r.R, r.G, r.B])) for r in read(f"{n}/colours").collect()}
                table = markers.factor_table(read(f"{n}/posterior").withColumnRenamed("cnt", "n"), read(f"{n}/markers")).orderBy(F.desc("weight")).collect()
                rows = [{"Factor": r.factor, "RGB": rgb.get(r.factor, "0,0,0"), "Weight": f"{r.weight:.5f}", "PostUMI": r.post_umi, "TopGene_pval": r.top_chi2, "TopGene_fc": r.top_fold, "TopGene_weight": r.top_weight} for r in table]
                sinks.write_bytes(spark, f"{n}/report.html", sinks.report(rows).encode())

            g.add(anchors, [model, pixels_path], project, "anchors")
            g.add(decoded, [anchors, model, pixels_path], run_decode, "decoded pixels")
            g.add(f"{name}/posterior", [decoded], post, "posterior counts")
            g.add(f"{name}/markers", [f"{name}/posterior"], test, "markers")
            g.add(f"{name}/colours", [anchors], paint, "colours")
            g.add(f"{name}/pixels.png", [decoded, f"{name}/colours"], draw, "image")
            g.add(f"{name}/report.html", [f"{name}/markers", f"{name}/colours"], tell, "report")
    return g


def targets(out: str, train_widths: list[float], n_factors: list[int]) -> list[str]:
    return [f"{out}/nF{k}.d_{w:g}/report.html" for w, k in product(train_widths, n_factors)]
