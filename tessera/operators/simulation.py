"""Simulated tissue with known cell types, and the scoring of results against it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.special import assignment
from tessera.functions.vectors import confusion
from tessera.operators.spatial import nearest_one

SHAPES = ("circle", "rod", "diamond")


def profiles(types: int, genes: int, strength: float = 8.0, seed: int = 0) -> np.ndarray:
    """Gene probabilities by type: a common profile, and for each type a block of its own genes that are ``strength`` times as frequent."""
    rng = np.random.default_rng(seed)
    base = rng.gamma(2.0, 1.0, genes)
    out = np.tile(base, (types, 1))
    for t, block in enumerate(np.array_split(np.arange(genes), types)):
        out[t, block] *= strength
    return out / out.sum(1, keepdims=True)


def cells(extent: float, spacing: float, types: int, layers: int = 2, seed: int = 0) -> pd.DataFrame:
    """Cells on a perturbed lattice: INDEX, x, y, cell_shape, cell_label, layer. Layers share the space in stripes and have types of their own."""
    rng = np.random.default_rng(seed)
    n = max(1, int(extent / spacing))
    gx, gy = np.meshgrid((np.arange(n) + 0.5) * spacing, (np.arange(n) + 0.5) * spacing)
    at = np.column_stack([gx.ravel(), gy.ravel()]) + rng.uniform(-0.2, 0.2, (n * n, 2)) * spacing
    layer = np.minimum((at[:, 0] / extent * layers).astype(int), layers - 1)
    groups = np.array_split(np.arange(types), layers)
    label = np.array([rng.choice(groups[k]) if len(groups[k]) else 0 for k in layer])
    return pd.DataFrame({"INDEX": np.arange(n * n), "x": at[:, 0], "y": at[:, 1], "cell_shape": np.array(SHAPES)[label % 3], "cell_label": [f"t{k}" for k in label], "layer": layer})


def inside(shape: str, dx: np.ndarray, dy: np.ndarray, r: float) -> np.ndarray:
    if shape == "circle":
        return dx * dx + dy * dy <= r * r
    if shape == "rod":
        return (np.abs(dx) <= r) & (np.abs(dy) <= r / 2)
    return np.abs(dx) + np.abs(dy) <= r * 1.25


def tissue(spark: SparkSession, extent: float = 120.0, density: float = 4.0, types: int = 3, genes: int = 60, spacing: float = 20.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels X, Y, gene, Count; truth X, Y, cell_id, cell_label, cell_shape; profiles gene, factor, lambda)."""
    rng, known, profile = np.random.default_rng(seed), cells(extent, spacing, types, 1, seed), profiles(types + 1, genes, seed=seed)
    n = int(extent * extent * density / 4)
    xy = np.round(rng.uniform(0, extent, (n, 2)), 2)
    owner, r = np.full(n, -1), spacing * 0.45
    for c in known.itertuples():
        near = np.flatnonzero((np.abs(xy[:, 0] - c.x) <= 2 * r) & (np.abs(xy[:, 1] - c.y) <= 2 * r) & (owner < 0))
        owner[near[inside(c.cell_shape, xy[near, 0] - c.x, xy[near, 1] - c.y, r)]] = c.INDEX
    label = np.where(owner >= 0, known.cell_label.to_numpy()[owner], "background")
    shape = np.where(owner >= 0, known.cell_shape.to_numpy()[owner], "background")
    kind = np.array([types if x == "background" else int(x[1:]) for x in label])
    gene = np.array([rng.choice(genes, p=profile[k]) for k in kind])
    pixels = pd.DataFrame({"X": xy[:, 0], "Y": xy[:, 1], "gene": [f"g{g}" for g in gene], "Count": np.ones(n, np.int32)})
    truth = pd.DataFrame({"X": xy[:, 0], "Y": xy[:, 1], "cell_id": owner, "cell_label": label, "cell_shape": shape})
    model = pd.DataFrame([(f"g{g}", k, float(profile[k, g] * 1000)) for k in range(types + 1) for g in range(genes)], columns=["gene", "factor", "lambda"])
    return spark.createDataFrame(pixels), spark.createDataFrame(truth), spark.createDataFrame(model)


def matched(results: DataFrame, truth: DataFrame, tol: float = 0.5, factor: str = "K1") -> DataFrame:
    """Results (X, Y, factor) with the label of the nearest true pixel within a tolerance."""
    left = results.select("X", "Y", factor)
    right = truth.select(F.col("X").alias("tx"), F.col("Y").alias("ty"), "cell_label", "cell_shape")
    return nearest_one(left, right, tol, rx="tx", ry="ty").select("X", "Y", factor, "cell_label", "cell_shape")


def scored(joined: DataFrame, factor: str = "K1") -> tuple[float, dict[int, str], pd.DataFrame]:
    """(accuracy, label by factor, confusion): factors are matched to labels for the most agreement."""
    table = confusion(joined, "cell_label", factor).toPandas()  # labels times factors
    if not len(table):
        return float("nan"), {}, table
    wide = table.pivot_table(index="cell_label", columns=factor, values="n", fill_value=0)
    pairs = assignment(wide.to_numpy())
    label = {int(wide.columns[j]): str(wide.index[i]) for i, j in pairs}
    return float(sum(wide.iat[i, j] for i, j in pairs) / table.n.sum()), label, table


def mismatches(joined: DataFrame, label: dict[int, str], factor: str = "K1") -> DataFrame:
    """The pixels whose factor stands for another label."""
    named = F.create_map(*[F.lit(x) for kv in label.items() for x in kv]) if label else F.lit(None)
    relabelled = F.coalesce(F.try_element_at(named, F.col(factor).cast("int")), F.lit("-")) if label else F.lit("-")
    return joined.withColumn("relabelled", relabelled).filter(F.col("relabelled") != F.col("cell_label"))
