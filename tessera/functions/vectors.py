"""Arrays of factor probabilities: top values, argmax, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(v: Column) -> Column:
    """The array divided by its sum."""
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(total, F.size(v)).alias("t")), lambda x: x["v"] / x["t"])


def top(v: Column, k: int) -> Column:
    """The k largest as array of (p, k); equal ones by lowest index."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("p"), i.alias("k")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["k"].alias("k"), (-x["p"]).alias("p")))


def argmax(v: Column) -> Column:
    """The place of the largest; of equal ones the first."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def with_top(df: DataFrame, k: int = 3, value: str = "theta") -> DataFrame:
    """Columns K1 ... Kk and P1 ... Pk."""
    out = df.withColumn("_top", top(F.col(value), k))
    cols = {f"{n}{i + 1}": F.get("_top", F.lit(i))[n.lower()] for n in "KP" for i in range(k)}
    return out.withColumns(cols).drop("_top")


def long(df: DataFrame, value: str = "theta") -> DataFrame:
    """One row for each factor: (..., factor, p)."""
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.posexplode(value).alias("factor", "p"))


def arrayed(df: DataFrame, keys: list[str], factor: str, p: str, k: int, name: str = "theta") -> DataFrame:
    """The arrays of k values from one row a factor; absent factors are 0."""
    pairs = F.map_from_entries(F.collect_list(F.struct(factor, p)))
    out = df.groupBy(*keys).agg(pairs.alias("_m"))
    return out.select(*keys, F.array(*(F.coalesce(F.try_element_at("_m", F.lit(i).cast(df.schema[factor].dataType)), F.lit(0.0)) for i in range(k))).alias(name))


def posterior_counts(theta: DataFrame, counts: DataFrame, unit: str = "unit", gene: str = "gene", n: str = "n", value: str = "theta") -> DataFrame:
    """(gene, factor, cnt): expected counts, the sum over units of probability times count."""
    both = counts.select(unit, gene, n).join(theta.select(unit, value), unit)
    return both.select(gene, n, F.posexplode(value).alias("factor", "p")).groupBy(gene, "factor").agg(F.sum(F.col("p") * F.col(n)).alias("cnt"))


def confusion(df: DataFrame, label: str, factor: str) -> DataFrame:
    return df.groupBy(label, factor).agg(F.count("*").alias("n"))
