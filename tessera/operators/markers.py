"""Marker tests: 2 x 2 chi-square of gene by factor, ranks, top lists, coherence.

Input is (gene, factor, n). Totals by gene and by factor are aggregations joined
back; the test is a closed form, so all of it stays in expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import chi2_pvalue, critical, linkage, neglog10_pvalue, newick


def chi_square(counts: DataFrame, min_ct: float = 50, genes: DataFrame | None = None) -> DataFrame:
    """(gene, factor, chi2, fold, gene_total) of pairs with a fold change of at least 1.

    Cells are rounded half to even, plus one. The fold change is infinite where
    a gene is in no other factor.
    """
    if genes is not None:
        counts = counts.join(genes.select("gene").distinct(), "gene", "left_semi")
    a = counts.groupBy("gene", "factor").agg(F.sum("n").cast("double").alias("a"))
    by_gene = a.groupBy("gene").agg(F.sum("a").alias("gt")).filter(F.col("gt") >= min_ct)
    a = a.join(by_gene, "gene")
    by_factor = a.groupBy("factor").agg(F.sum("a").alias("kt"))
    a = a.join(F.broadcast(by_factor), "factor")  # one row a factor
    total = by_factor.agg(F.sum("kt")).first()[0] or 0.0
    a = a.withColumns({"b": F.col("gt") - F.col("a"), "c": F.col("kt") - F.col("a"), "d": F.lit(float(total)) - F.col("kt") - F.col("gt") + F.col("a")})
    rest = F.lit(float(total)) - F.col("kt")
    fold = F.when(F.col("b") > 0, (F.col("a") / F.col("kt")) / F.try_divide(F.col("b"), rest)).otherwise(F.lit(float("inf")))
    a = a.withColumn("fold", fold).filter((F.col("a") > 0) & (F.col("fold") >= 1))
    w, x, y, z = (F.rint(F.col(c)) + F.lit(1.0) for c in "abcd")
    det = w * z - x * y
    chi2 = (w + x + y + z) * det * det / ((w + x) * (y + z) * (w + y) * (x + z))
    return a.select("gene", F.col("factor").cast("string").alias("factor"), chi2.alias("chi2"), "fold", F.col("gt").cast("long").alias("gene_total"))


def average_rank(value: Column, by: str, descending: bool = True) -> Column:
    """The rank within a group where ties share the mean of their ranks."""
    order = value.desc() if descending else value.asc()
    w = Window.partitionBy(by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(w.partitionBy(by, value)) - 1) / F.lit(2.0)


def ranked(tests: DataFrame, p: float = 1e-3, fold: float = 1.5, min_output: int = 10) -> DataFrame:
    """Significant markers, and those of an average rank below ``min_output``, with the rank."""
    out = tests.withColumn("rank", average_rank(F.col("chi2"), "factor"))
    return out.filter(((F.col("chi2") > critical(p)) & (F.col("fold") > fold)) | (F.col("rank") < min_output))


def with_pvalues(tests: DataFrame) -> DataFrame:
    """chi2 with one decimal, fold with two, pval, and log10pval from the rounded chi2."""
    out = tests.withColumns({"pval": chi2_pvalue("chi2"), "chi2": F.round("chi2", 1), "fold": F.round("fold", 2)})
    return out.withColumn("log10pval", neglog10_pvalue("chi2"))


def top_genes(tests: DataFrame, n: int = 20, value: str = "chi2", p: float = 1e-3, fold: float = 1.5, min_top: int = 10) -> DataFrame:
    """(factor, genes): up to n genes a factor in descending order, joined; the significant ones and the first ``min_top`` - 1."""
    w = Window.partitionBy("factor")
    out = tests.withColumns({"_rank": F.rank().over(w.orderBy(F.col(value).desc())), "_row": F.row_number().over(w.orderBy(F.col(value).desc(), "gene"))})
    kept = out.filter((F.col("_rank") < min_top) | ((F.col("chi2") > critical(p)) & (F.col("fold") >= fold)))
    kept = kept.withColumn("_row", F.row_number().over(w.orderBy("_row"))).filter(F.col("_row") <= n)
    return kept.groupBy("factor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "gene"))), lambda x: x["gene"]), ", ").alias("genes"))


def factor_table(counts: DataFrame, tests: DataFrame, n: int = 20, least: float = 10, min_top: int = 10) -> DataFrame:
    """(factor, weight, post_umi, top_chi2, top_fold, top_weight) of factors with at least ``least`` counts."""
    by = counts.groupBy(F.col("factor").cast("string").alias("factor"), "gene").agg(F.sum("n").cast("double").alias("n"))
    size = by.groupBy("factor").agg(F.sum("n").alias("_n"))
    share = size.select("factor", (F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1)))).alias("weight"), F.col("_n").cast("long").alias("post_umi"))
    w = Window.partitionBy("factor").orderBy(F.col("n").desc(), "gene")
    heavy = by.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") <= n)
    heavy = heavy.groupBy("factor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "gene"))), lambda x: x["gene"].cast("string")), ", ").alias("top_weight"))
    out = share.filter(F.col("post_umi") >= least).join(heavy, "factor", "left")
    for name, value in (("top_chi2", "chi2"), ("top_fold", "fold")):
        out = out.join(top_genes(tests, n, value, min_top=min_top).withColumnRenamed("genes", name), "factor", "left")
    return out.select("factor", "weight", "post_umi", *(F.coalesce(c, F.lit(".")).alias(c) for c in ("top_chi2", "top_fold", "top_weight")))


def factor_tree(counts: DataFrame, names: dict[str, str] | None = None) -> str:
    """Factors by complete linkage of their genes' shares (1 - the cosine of square roots), as Newick text: K x K sums come to the driver."""
    by = counts.groupBy(F.col("factor").cast("string").alias("a"), "gene").agg(F.sum("n").cast("double").alias("n"))
    share = by.select("a", "gene", F.sqrt(F.col("n") / F.sum("n").over(Window.partitionBy("a"))).alias("p"))
    other = share.select(F.col("a").alias("b"), "gene", F.col("p").alias("q"))
    sums = share.join(other, "gene").groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("w")).toPandas()
    order = sorted(set(sums["a"]), key=lambda x: (len(x), x))
    at, d = {x: i for i, x in enumerate(order)}, np.ones((len(order), len(order)))
    d[sums["a"].map(at), sums["b"].map(at)] = 1 - sums["w"]
    return newick(linkage(d), [(names or {}).get(x, x) for x in order])


def coherence(counts: DataFrame, theta: DataFrame, markers: DataFrame) -> DataFrame:
    """(factor, score0, score): co-occurrence of each factor's markers.

    ``counts`` (unit, gene, n), ``theta`` (unit, factor, p), ``markers`` (factor,
    gene), some ten a factor. Pairs of markers are taken in the order of the
    genes' shares; units meet pairs through their own counts only.
    """
    total = counts.groupBy("gene").agg(F.sum("n").cast("double").alias("f"))
    w = Window.partitionBy("factor").orderBy(F.col("f").desc(), "gene")
    m = markers.join(total, "gene").withColumn("_r", F.row_number().over(w))
    pairs = m.select("factor", F.col("gene").alias("gi"), F.col("f").alias("fi"), F.col("_r").alias("ri")).join(m.select("factor", F.col("gene").alias("gj"), F.col("f").alias("fj"), F.col("_r").alias("rj")), "factor").filter("ri < rj").drop("ri", "rj")
    ni = counts.filter("n > 0").select("unit", F.col("gene").alias("gi"), F.col("n").alias("ni")).join(pairs, "gi")
    nj = counts.select("unit", F.col("gene").alias("gj"), F.col("n").alias("nj"))
    both = ni.join(nj, ["unit", "gj"], "left").join(theta, ["unit", "factor"])
    expected = F.col("ni") * F.col("fj") / F.col("fi")
    term = F.col("p") * F.log(F.coalesce("nj", F.lit(0)) / expected + F.lit(1.0))
    s = both.groupBy("factor").agg(F.sum(term).alias("score0"))
    mass = theta.groupBy("factor").agg(F.sum("p").alias("_p"))
    return s.join(mass, "factor").select("factor", "score0", (F.col("score0") / F.col("_p")).alias("score"))


def pair_information(counts: DataFrame, markers: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """(factor, pmi): the mean pointwise mutual information of a factor's markers over units, with a pseudo-count."""
    n = counts.select("unit").distinct().count()
    present = counts.filter("n > 0").select("unit", "gene").distinct()
    single = present.groupBy("gene").agg(F.count("*").alias("c"))
    m = markers.select("factor", "gene").distinct()
    pairs = m.withColumnRenamed("gene", "gi").join(m.withColumnRenamed("gene", "gj"), "factor").filter("gi < gj")
    both = present.withColumnRenamed("gene", "gi").join(F.broadcast(pairs.select("gi", "gj").distinct()), "gi").join(present.withColumnRenamed("gene", "gj"), ["unit", "gj"]).groupBy("gi", "gj").agg(F.count("*").alias("cij"))
    out = pairs.join(both, ["gi", "gj"], "left").join(single.toDF("gi", "ci"), "gi").join(single.toDF("gj", "cj"), "gj")
    pmi = F.log((F.coalesce("cij", F.lit(0)) + pseudo) * (n + pseudo) / ((F.col("ci") + pseudo) * (F.col("cj") + pseudo)))
    return out.groupBy("factor").agg(F.avg(pmi).alias("pmi"))
