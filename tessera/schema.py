"""Names of columns: header normalisation, factor columns, and units."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A factor column: optional letters and underscores, then the factor's number.
FACTOR = re.compile(r"^[A-Za-z]*_*(\d+)$")


def normalised(df: DataFrame, mode: str = "all") -> DataFrame:
    """Header normalisation.

    ``all``: names of one letter in upper case, longer ones in lower case;
    ``xy``: x and y in upper case, the others as they are.
    """
    if mode == "all":
        return df.toDF(*(c.upper() if len(c) == 1 else c.lower() for c in df.columns))
    if mode == "xy":
        return df.toDF(*(c.upper() if c.lower() in ("x", "y") else c for c in df.columns))
    raise ValueError(f"unknown mode {mode!r}")


def factor_columns(columns: list[str]) -> dict[str, str]:
    """Factor columns by their number as text, in numeric order."""
    found = {m[1]: c for c in columns if (m := FACTOR.match(c.strip()))}
    return {k: found[k] for k in sorted(found, key=int)}


def theta(df: DataFrame, name: str = "theta") -> DataFrame:
    """The factor columns as one array, in numeric order; the columns themselves go."""
    cols = list(factor_columns(df.columns).values())
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.array(*(F.col(f"`{c}`").cast("double") for c in cols)).alias(name))


def wide(df: DataFrame, k: int, name: str = "theta") -> DataFrame:
    """The array as factor columns 0 ... k - 1, for export."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *(F.get(F.col(name), F.lit(i)).alias(str(i)) for i in range(k)))


def micrometres(df: DataFrame, mu_scale: float, *cols: str) -> DataFrame:
    """Coordinates divided by the raw units in a micrometre."""
    return df.withColumns({c: F.col(c) / F.lit(float(mu_scale)) for c in cols or ("X", "Y")})


def pixel_key(x: str = "X", y: str = "Y") -> Column:
    """A pixel's key; coordinates are kept as they are, text is for export only."""
    return F.struct(F.col(x).alias("X"), F.col(y).alias("Y"))
