"""Tail probabilities as pandas UDFs; they run on the few rows that a test leaves."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def chi2_tail(x: float, df: int) -> float:
    """P(chi² > x) for a whole number of degrees: a finite sum for even, an erfc and a sum for odd."""
    if not x > 0 or df < 1:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return math.exp(-h) * total
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return total


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(float(a), int(b)) for a, b in zip(x, df)], dtype="float64")


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else math.erfc(abs(float(a)) / math.sqrt(2)) for a in z], dtype="float64")


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties: the share of all orders of the rows whose U is as far out, by counts added up row by row."""
    small, large = sorted((n1, n2))
    # ways to reach each U with j rows of the smaller group among the first rows
    ways = [[1] + [0] * (small * large)] + [[0] * (small * large + 1) for _ in range(small)]
    for row in range(small + large):
        for j in range(min(row + 1, small), 0, -1):
            add = row - (j - 1)  # rows of the larger group before this one
            if add <= large:
                here, less = ways[j], ways[j - 1]
                for k in range(small * large, add - 1, -1):
                    here[k] += less[k - add]
    far = math.floor(min(u, n1 * n2 - u))
    return min(1.0, 2 * sum(ways[small][: far + 1]) / math.comb(small + large, small))


@pandas_udf(DoubleType())
def exact_mann_whitney(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else mann_whitney_exact(float(a), int(b), int(c)) for a, b, c in zip(u, n1, n2)], dtype="float64")
