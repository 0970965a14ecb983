"""Filters of pixels, units and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_box(df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, inclusive: bool = True, x: str = "X", y: str = "Y") -> DataFrame:
    """Rows inside a box; the comparisons reach the scan."""
    if inclusive:
        return df.filter((F.col(x) >= xmin) & (F.col(x) <= xmax) & (F.col(y) >= ymin) & (F.col(y) <= ymax))
    return df.filter((F.col(x) > xmin) & (F.col(x) < xmax) & (F.col(y) > ymin) & (F.col(y) < ymax))


def with_features(df: DataFrame, features: DataFrame, gene: str = "gene") -> DataFrame:
    """Rows of listed features."""
    return df.join(features.select(gene).distinct(), gene, "left_semi")


def positive(df: DataFrame, key: str = "Count") -> DataFrame:
    return df.filter(F.col(key) > 0)


def feature_totals(df: DataFrame, key: str = "Count", gene: str = "gene") -> DataFrame:
    return df.groupBy(gene).agg(F.sum(key).alias("total"))


def kept_features(df: DataFrame, min_ct: float, white: DataFrame | None = None, key: str = "Count", gene: str = "gene") -> DataFrame:
    """Features with a total of at least ``min_ct``, or on the white list."""
    totals = feature_totals(df, key, gene)
    if white is None:
        return totals.filter(F.col("total") >= min_ct)
    listed = white.select(gene).distinct().withColumn("_listed", F.lit(True))
    return totals.join(listed, gene, "left").filter((F.col("total") >= min_ct) | F.col("_listed")).drop("_listed")


def forced_features(df: DataFrame, listed: DataFrame, key: str = "Count", gene: str = "gene") -> DataFrame:
    """All listed features, those without counts with total 0."""
    return listed.select(gene).distinct().join(feature_totals(df, key, gene), gene, "left").fillna(0, ["total"])


def without(df: DataFrame, pattern: str, column: str = "gene") -> DataFrame:
    """Rows whose column does not match a pattern, whatever the case: control probes."""
    return df.filter(~F.col(column).rlike(f"(?i){pattern}"))


def where(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    """A free predicate, as SQL text or column; the place of shell filters."""
    return df if predicate is None else df.filter(predicate)


def dummies(df: DataFrame, column: str, values: list) -> DataFrame:
    """One 0/1 column for each value."""
    return df.withColumns({str(v): (F.col(column) == v).cast("int") for v in values})


def clipped(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def train_test(unit: Column, train: float, seed: int = 0) -> Column:
    """Whether a unit is for training: a share by hash of seed and unit, which any engine with MD5 can repeat."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), unit.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % 1_000_000 < int(train * 1_000_000)


def limited(df: DataFrame, most: int = 0) -> DataFrame:
    """The first rows only, for a trial run; all if ``most`` is 0."""
    return df.limit(most) if most > 0 else df


def sampled(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by the least hashes of seed and key: the same ones in every run; a top-n, not a sort of all rows."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    return df.orderBy(order, F.col(key)).limit(n)


def even_slices(n: int, parts: int) -> list[tuple[int, int]]:
    """[start, end) of at most ``parts`` slices of n items whose sizes differ by one at most; at least one."""
    parts = max(1, min(parts, n))
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def sliced(df: DataFrame, parts: int, order: str) -> DataFrame:
    """``df`` with ``slice``, the number of its even slice in an order, from 0: bounds are quantiles, so no task sorts all rows."""
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    at = sum((F.when(F.col(order) > F.lit(c), 1).otherwise(0) for c in cuts or []), F.lit(0))
    return df.withColumn("slice", at)
