"""Online variational latent Dirichlet allocation on packed units.

The model is a small K x M matrix on the driver. A step sends it to the tasks,
which infer the units of one batch, a block at a time, and return expected
counts by factor and gene, of the genes that they met, as arrays by ranges of genes;
these are summed by Spark, and only the K x M sums come back. Batches are hash
buckets of units, of which an epoch has at most ``STEPS``. They are held in
memory in their order, or from ``HELD`` units on in a folder each of the shared
scratch, so that a step reads its own batch only. Several models
learn in one pass. Random starts are hashes of seed, step and unit: a model does not depend on how units
are partitioned, nor on executors that are lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import expected_log, gammaln, logsumexp
from tessera.functions.vectors import long, posterior_counts
from tessera.operators.markers import chi_square, coherence
from tessera.operators.matrix import parts

EPS = 1e-100
#: Units inferred together by a task.
BLOCK = 512
#: Entries of units that are inferred as one dense product.
ENTRIES = 1 << 14
#: Genes whose sums are added up in one place at least, and batches of an epoch at most.
RANGE, STEPS = 2048, 64
#: Units that are held in memory at most, and units of a task that writes them by batch.
HELD, WRITTEN = 1 << 17, 1 << 16


def starts(keys: np.ndarray, k: int) -> np.ndarray:
    """Random numbers like Gamma(100, 0.01), a row of k for each 64-bit key, by hashing and a cube of a normal number."""
    at = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        at = (at ^ (at >> np.uint64(shift))) * np.uint64(factor)
    u = ((at ^ (at >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    z = np.sqrt(-2 * np.log(1 - u[:, :k])) * np.cos(2 * np.pi * u[:, k:])
    return (1 - 1 / 900 + z / 30) ** 3


def unmixed(stats: np.ndarray, lam: np.ndarray, penalty: float, ambient: np.ndarray | None = None, ambient_only: bool = False) -> np.ndarray:
    """Expected counts (K x M) less a share ``penalty`` of each factor's total, taken as what leaks in from elsewhere, and scaled up again.

    Elsewhere are the other factors by their weight and the ambient profile, or
    the ambient profile only.
    """
    leak = penalty * stats.sum(1, keepdims=True)
    if ambient_only and ambient is not None:
        from_others = np.broadcast_to(ambient, stats.shape)
    else:
        profile, weight = lam / lam.sum(1, keepdims=True), lam.sum(1) / lam.sum()
        mix = weight @ profile
        if ambient is not None:  # weighs as much as all factors
            weight, mix = weight / 2, (mix + ambient) / 2
        from_others = mix - weight[:, None] * profile
    return np.maximum((stats - leak * from_others) / (1 - penalty), EPS)


def _bundles(begins: np.ndarray, size: np.ndarray, cols: np.ndarray, vals: np.ndarray, by_gene: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(units, their genes' rows U x L x K, their counts U x L): units of about one length, filled up with zeros."""
    order = np.argsort(size, kind="stable")
    lengths = size[order]
    a = int(np.searchsorted(lengths, 0, "right"))
    while a < len(order):
        most = int(lengths[a] + lengths[a] // 4 + 4)
        e = min(int(np.searchsorted(lengths, most, "right")), a + max(1, ENTRIES // most))
        live, steps = order[a:e], np.arange(lengths[e - 1])
        inside = steps < size[live][:, None]
        at = np.where(inside, begins[live][:, None] + steps, begins[live][:, None])
        yield live, by_gene[cols[at]] * inside[:, :, None], vals[at] * inside
        a = e


def infer(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, beta: np.ndarray, alpha: float | np.ndarray, start: np.ndarray | None = None, rounds: int = 100, tol: float = 1e-3, expect: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(gamma n x K, sums K x M): the variational posterior of units with exp(E[log beta]) given; without ``expect`` no sums.

    Entries are in the order of units. Units of about one length are inferred
    together as small dense products; a unit stops by itself when its mean
    absolute change is below ``tol``.
    """
    k, m = beta.shape
    gamma = np.ones((n, k)) if start is None else start.copy()
    begins, by_gene = np.searchsorted(rows, np.arange(n + 1)), np.ascontiguousarray(beta.T)
    size = np.diff(begins)
    gamma[size == 0] = alpha
    theta, sums, open_ = np.exp(expected_log(gamma)), np.zeros((n, k)), size > 0
    bundles = list(_bundles(begins, size, cols, vals, by_gene))
    for _ in range(rounds):
        if not open_.any():
            break
        for i, (live, b, v) in enumerate(bundles):
            left = open_[live]
            if 2 * left.sum() <= len(live):  # else the places of those that stopped stay
                live, b, v = bundles[i] = (live[left], b[left], v[left])
            share = v / (np.matmul(b, theta[live][:, :, None])[:, :, 0] + EPS)
            sums[live] = np.matmul(share[:, None, :], b)[:, 0]
        live = np.flatnonzero(open_)
        new = alpha + theta[live] * sums[live]
        change = np.abs(new - gamma[live]).mean(1)
        gamma[live] = new
        theta[live] = np.exp(expected_log(new))
        open_[live[change < tol]] = False
    if not expect:
        return gamma, None
    stats = np.zeros((k, m))
    if len(rows):
        by_entry = by_gene[cols]
        share = vals / (np.einsum("ij,ij->i", theta[rows], by_entry) + EPS)
        weighted = theta[rows] * share[:, None]
        for i in range(k):
            stats[i] = np.bincount(cols, weighted[:, i], m)
    return gamma, stats * beta


def _coo(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch["idx"].map(len).to_numpy()
    flat = lambda c: np.concatenate(batch[c].to_list()) if n.sum() else np.zeros(0)
    return np.repeat(np.arange(len(batch)), n), flat("idx").astype(np.int64), flat("cnt").astype(float)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            yield batch.iloc[a : a + BLOCK]


def expected_all(models: list[Lda], units: DataFrame) -> tuple[np.ndarray, int]:
    """(sums R x K x M, number of units): one expectation step of R models of the same genes in one pass over ``units``.

    An ambient profile takes part as a fixed factor. A block is inferred with the
    rows of its own genes, and a task sends the sums of the genes that it met as
    arrays by ranges of genes, each of which is added up in one place, so that a
    step's work follows its units and moves a row a task for each of M / RANGE ranges, or of two a core, and not one for each factor and gene.
    """
    spark, k, m, seen = units.sparkSession, models[0].k, len(models[0].genes), []
    width = max(RANGE, -(-m // (2 * max(spark.sparkContext.defaultParallelism, 1))))
    for x in models:
        beta = x.beta()
        if x.ambient is not None:  # as sure of itself as the factors are on average
            beta = np.vstack([beta, np.exp(expected_log(x.ambient[None] * x.lam.sum(1).mean() + EPS))])
        seen.append((np.ascontiguousarray(beta.T), x.alpha))
    r, sent = len(models), spark.sparkContext.broadcast(seen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((r, k, m)), 0
        for b in _blocks(batches):
            rows, cols, vals = _coo(b)
            met, cols = np.unique(cols, return_inverse=True)
            first = np.array(b["h"].to_list(), np.int64).reshape(len(b), r)
            for i, (by_gene, alpha) in enumerate(sent.value):
                total[i][:, met] += infer(rows, cols, vals, len(b), by_gene[met].T, alpha, starts(first[:, i], by_gene.shape[1]))[1][:k]
            n += len(b)
        parts = [total[:, :, a : a + width] for a in range(0, m, width)]
        met = [np.flatnonzero(x.any((0, 1))) for x in parts]
        yield pd.DataFrame({"part": range(len(parts)), "n": n, "met": [g.astype(np.int32).tobytes() for g in met], "v": [x[:, :, g].tobytes() for x, g in zip(parts, met)]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((r * k, min(width, m - int(part["part"].iloc[0]) * width)))
        for g, x in zip(part["met"], part["v"]):
            g = np.frombuffer(g, np.int32)
            v[:, g] += np.frombuffer(x).reshape(r * k, len(g))
        return pd.DataFrame({"part": part["part"].iloc[:1], "n": [int(part["n"].sum())], "v": [v.tobytes()]})

    first = F.array(*(F.xxhash64(F.lit(x.seed), F.lit(x.step), "unit") for x in models)).alias("h")
    by_task = units.select("idx", "cnt", first).mapInPandas(run, "part long, n long, met binary, v binary")
    try:
        got = by_task.groupBy("part").applyInPandas(add, "part long, n long, v binary").collect()  # as large as the models
    finally:
        sent.destroy()
    sums, n = np.zeros((r, k, m)), 0
    for row in got:
        here = sums[:, :, row.part * width : (row.part + 1) * width]
        here += np.frombuffer(bytes(row.v)).reshape(here.shape)
        n = row.n
    return sums, n


def _by_batch(units: DataFrame, rows: int) -> DataFrame:
    """``units`` held in the order of _b, in pieces of about the ``rows`` that a partition has of a batch: a step passes over the other pieces by their bounds."""
    conf, name = units.sparkSession.conf, "spark.sql.inMemoryColumnarStorage.batchSize"
    before = conf.get(name)
    conf.set(name, str(min(max(rows, 16), int(before))))
    try:
        held = units.sortWithinPartitions("_b").persist()
    finally:
        conf.set(name, before)
    held.count()
    return held


@contextmanager
def _dealt(units: DataFrame, seed: int, batch_size: int) -> Iterator[tuple[int, int, Callable[[int], DataFrame]]]:
    """(number of units, number of batches, the units of each): in memory, or more than ``HELD`` in a folder for each batch, which goes at the end."""
    spark = units.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, 1)
    once = units.select("unit", "idx", "cnt").persist(StorageLevel.DISK_ONLY)
    here, path, held = once.count(), None, None
    batches = max(1, min(here // batch_size, STEPS))
    dealt = once.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(batches)).cast("int"))
    try:
        if here > HELD:
            base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
            path = f"{base.rstrip('/')}/tessera-units-{uuid.uuid4().hex}"
            dealt.coalesce(max(cores, here // WRITTEN)).write.partitionBy("_b").parquet(path)
            kept = spark.read.schema(dealt.schema).parquet(path)
        else:
            kept = held = _by_batch(dealt.repartition(cores, "unit"), here // (batches * cores))
        once.unpersist()
        yield here, batches, lambda b: (kept.filter(F.col("_b") == int(b)) if batches > 1 else kept).coalesce(cores)
    finally:
        once.unpersist()
        if held is not None:
            held.unpersist()
        if path is not None:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fit_all(models: list[Lda], units: DataFrame, epochs: float = 1, batch_size: int = 512, total: int | None = None) -> None:
    """Stochastic learning of several models of the same genes: a step is one pass over a batch for all of them, in the order of the first one's seed.

    An epoch has at most ``STEPS`` batches, so that a step has work for all cores
    however many units there are. A step has one task a core.
    """
    seed = models[0].seed
    with _dealt(units, seed, batch_size) as (here, batches, batch):
        n, epoch, left = total or here, 0, max(1, round(epochs * batches)) if epochs > 0 else 0
        while left > 0:
            order = np.random.Generator(np.random.PCG64([seed, epoch])).permutation(batches)[:left]
            for b in order:
                sums, got = expected_all(models, batch(b))
                for x, v in zip(models, sums):
                    x.moved(v, got, n)
            left, epoch = left - len(order), epoch + 1


@dataclass
class Lda:
    """A model of ``k`` factors over the genes of an index; ``lam`` is its Dirichlet parameter, K x M."""

    genes: list
    k: int
    alpha: float | None = None
    eta: float | None = None
    tau: float = 9.0
    kappa: float = 0.7
    seed: int = 0
    lam: np.ndarray | None = None
    step: int = 0
    penalty: float = 0.0
    ambient: np.ndarray | None = None
    ambient_only: bool = False
    meta: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.alpha = 1 / self.k if self.alpha is None else self.alpha
        self.eta = 1 / self.k if self.eta is None else self.eta
        if self.lam is None:
            self.lam = np.random.Generator(np.random.PCG64(self.seed)).gamma(100.0, 0.01, (self.k, len(self.genes)))

        if self.ambient is not None:
            self.ambient = np.asarray(self.ambient, float) / np.sum(self.ambient)

    def beta(self) -> np.ndarray:
        return np.exp(expected_log(self.lam))

    # --- learning ---

    def expected(self, units: DataFrame) -> tuple[np.ndarray, int]:
        """(sums K x M, number of units): one expectation step over all of ``units``."""
        sums, n = expected_all([self], units)
        return sums[0], n

    def moved(self, sums: np.ndarray, n: int, total: float) -> None:
        """One stochastic step by the sums of n units, of ``total`` in all."""
        if n:
            if self.penalty > 0 and self.step > 3:
                sums = unmixed(sums, self.lam, self.penalty, self.ambient, self.ambient_only)
            self.step += 1
            rho = (self.tau + self.step) ** -self.kappa
            self.lam = (1 - rho) * self.lam + rho * (self.eta + total / n * sums)

    def update(self, units: DataFrame, total: float) -> int:
        """One stochastic step with the units of a batch, of ``total`` units in all."""
        sums, n = self.expected(units)
        self.moved(sums, n, total)
        return n

    def batch_update(self, units: DataFrame) -> int:
        """One step of batch learning."""
        sums, n = self.expected(units)
        self.step += 1
        self.lam = self.eta + sums
        return n

    def fit(self, units: DataFrame, epochs: float = 1, batch_size: int = 512, total: int | None = None) -> Lda:
        """Stochastic learning: every epoch visits all batches, in another order; a fraction of an epoch visits that share of them."""
        fit_all([self], units, epochs, batch_size, total)
        return self

    # --- use ---

    def transform(self, units: DataFrame, keep: tuple[str, ...] = ("unit",)) -> DataFrame:
        """(unit, theta): factor probabilities of each unit."""
        beta, alpha = self.beta(), self.alpha

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _blocks(batches):
                gamma, _ = infer(*_coo(b), len(b), beta, alpha, expect=False)
                out = b[list(keep)].copy()
                out["theta"] = list(gamma / gamma.sum(1, keepdims=True))
                yield out

        cols = [*keep, *(c for c in ("idx", "cnt") if c not in keep)]
        schema = ", ".join([*(f"{c} {units.schema[c].dataType.simpleString()}" for c in keep), "theta array<double>"])
        return units.select(*cols).mapInPandas(run, schema)

    def bound(self, units: DataFrame) -> tuple[float, float]:
        """(variational bound, perplexity) of units."""
        log_beta, alpha, k = expected_log(self.lam), self.alpha, self.k
        beta = np.exp(log_beta)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _blocks(batches):
                rows, cols, vals = _coo(b)
                gamma, _ = infer(rows, cols, vals, len(b), beta, alpha, expect=False)
                log_theta = expected_log(gamma)
                score = float((vals * logsumexp(log_theta[rows] + log_beta.T[cols], 1)).sum()) if len(rows) else 0.0
                score += float(((alpha - gamma) * log_theta + gammaln(gamma) - gammaln(alpha)).sum() + (gammaln(alpha * k) - gammaln(gamma.sum(1))).sum())
                yield pd.DataFrame({"s": [score], "n": [float(vals.sum())]})

        s, n = units.select("idx", "cnt").mapInPandas(run, "s double, n double").agg(F.sum("s"), F.sum("n")).first()
        s, n = s or 0.0, n or 0.0
        s += float(((self.eta - self.lam) * log_beta + gammaln(self.lam) - gammaln(self.eta)).sum() + (gammaln(self.eta * self.lam.shape[1]) - gammaln(self.lam.sum(1))).sum())
        return s, float(np.exp(-s / n)) if n else float("nan")

    def relabelled(self) -> Lda:
        """Factors in descending order of their weight."""
        self.lam = self.lam[np.argsort(-self.lam.sum(1), kind="stable")]
        return self

    def matrix(self, spark) -> DataFrame:
        """(gene, factor, lambda) as a table."""
        k, m = self.lam.shape
        table = pa.table({"gene": [str(g) for g in np.tile(np.array(self.genes, object), k)], "factor": np.repeat(np.arange(k), m), "lambda": self.lam.ravel()})
        return spark.createDataFrame(table)

    def save(self, spark, path: str) -> None:
        """Parquet for the matrix, JSON for the rest; nothing is pickled."""
        self.matrix(spark).write.mode("overwrite").parquet(f"{path}/matrix")
        meta = {"k": self.k, "alpha": self.alpha, "eta": self.eta, "tau": self.tau, "kappa": self.kappa, "seed": self.seed, "step": self.step, "penalty": self.penalty, "ambient": None if self.ambient is None else self.ambient.tolist(), "ambient_only": self.ambient_only, "genes": [str(g) for g in self.genes], "meta": self.meta}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Lda:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/matrix").toPandas()
        at = {g: i for i, g in enumerate(meta["genes"])}
        lam = np.zeros((meta["k"], len(at)))
        lam[rows.factor.to_numpy(), rows.gene.map(at).to_numpy()] = rows["lambda"].to_numpy()
        return cls(lam=lam, **meta)


def from_pseudobulk(model: DataFrame, genes: list, min_total: float = 50, pseudo: float = 0.1, scale: float = 0.0, total: float = 0.0, **options) -> Lda:
    """A model from a table (gene, factor, lambda): genes of both with enough weight, plus a pseudo-count, optionally scaled to a share of ``total``."""
    rows = model.toPandas()
    wide = rows.pivot_table(index="gene", columns="factor", values="lambda", aggfunc="sum", fill_value=0.0)
    wide = wide[wide.sum(axis=1) >= min_total]
    kept = [g for g in map(str, genes) if g in wide.index]
    lam = wide.loc[kept].to_numpy(float).T + pseudo
    if not kept:
        raise ValueError("the model and the counts have no gene in common")
    if scale > 0 and lam.sum() > 0:
        lam *= scale * total / lam.sum()
    return Lda(kept, lam.shape[0], lam=lam, **options)


def restarts(units: DataFrame, counts: DataFrame, genes: list, k: int, r: int = 5, train: float = 0.5, epochs: int = 1, seed: int = 0, top: int = 10, **options) -> tuple[Lda, DataFrame]:
    """(best model, coherence (R, factor, score0, score)): r starts on a share of the units, scored on the rest."""
    fitting, testing = parts(units, train, seed)
    fitting, testing = fitting.persist(), testing.persist()
    scores = []
    names = units.sparkSession.createDataFrame([(str(g), i) for i, g in enumerate(genes)], "gene string, idx int")
    held = testing.select("unit", F.explode(F.arrays_zip("idx", "cnt")).alias("z")).select("unit", F.col("z.idx").alias("idx"), F.col("z.cnt").alias("n")).join(names, "idx").select("unit", "gene", "n")
    models = [Lda(genes, k, seed=seed + i, **options) for i in range(r)]
    fit_all(models, fitting, epochs)  # all starts in one pass a step
    for i, model in enumerate(models):
        theta = model.transform(testing).persist()
        post = posterior_counts(theta, held).withColumnRenamed("cnt", "n")
        tests = chi_square(post, 0)
        best = tests.withColumn("_r", F.row_number().over(Window.partitionBy("factor").orderBy(F.col("chi2").desc(), "gene"))).filter(F.col("_r") <= top).select(F.col("factor").cast("int").alias("factor"), "gene")
        scores.append(coherence(held, long(theta).select("unit", "factor", "p"), best).toPandas().assign(R=i))
        theta.unpersist()
    fitting.unpersist(), testing.unpersist()
    every = pd.concat(scores)
    mean = every.groupby("R")["score"].mean()
    chosen = int(mean.idxmax()) if len(mean) else 0
    table = units.sparkSession.createDataFrame(every[["R", "factor", "score0", "score"]]) if len(every) else units.sparkSession.createDataFrame([], "R long, factor int, score0 double, score double")
    return models[chosen], table
