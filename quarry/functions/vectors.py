"""Column functions for vectors, arrays of double: similarity, norms, pooling, fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda n, x: n + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2norm(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def similarity(a: Column, b: Column, kind: str = "cosine") -> Column:
    """cosine (0 with a zero vector), clamped (cosine of at least 0), dot, l2 and l1 (negative distances)."""
    if kind == "dot":
        return dot(a, b)
    if kind == "l2":
        return -F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if kind == "l1":
        return -total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    length = norm(a) * norm(b)
    cosine = F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(length, F.lit(0.0)))
    return F.greatest(F.lit(0.0), cosine) if kind == "clamped" else cosine


def bilinear(weights: list[list[float]], bias: float = 0.0) -> Callable[[Column, Column], Column]:
    """A similarity: a' W b + bias, with supplied weights."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in weights))
    return lambda a, b: dot(a, F.transform(rows, lambda row: dot(row, b))) + bias


def mlp(w1: list[list[float]], w2: list[list[float]], out: list[float]) -> Callable[[Column, Column], Column]:
    """A similarity: a scorer with supplied weights on both vectors, two layers, each cut at 0, and a linear one. The weights go
    to the tasks as a closure; a null vector counts as zeros."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        width = len(w1) // 2
        x = np.concatenate([np.stack([np.zeros(width) if v is None else v for v in side]) for side in (a, b)], axis=1)
        return pd.Series(np.maximum(np.maximum(x @ np.array(w1), 0) @ np.array(w2), 0) @ np.array(out))

    return score


def by_dimension(df: DataFrame, keys: list[str], value: Column, vector: str = "v", how: str = "avg") -> DataFrame:
    """(keys, v): element-wise avg, sum or max over the rows of each group, each element through `value` of column x."""
    long = df.select(*keys, F.posexplode(vector).alias("dim", "x"), *[c for c in df.columns if c not in (*keys, vector)])
    fold = {"avg": F.avg, "sum": F.sum, "max": F.max}[how]
    cells = long.groupBy(*keys, "dim").agg(fold(value).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["x"]).alias(vector))


def mean_vector(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    return by_dimension(df, keys, F.col("x"), vector, "avg")


def sum_vector(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    return by_dimension(df, keys, F.col("x"), vector, "sum")


def rounded(v: Column, digits: int = 6, signed: bool = False) -> Column:
    """Each element rounded; what rounds to zero is a plain 0, or with signed keeps its sign, as rounding in SQL does."""
    if not signed:
        return F.transform(v, lambda x: F.round(x, digits))
    return F.transform(v, lambda x: F.when(F.round(x, digits) == 0, x * 0.0).otherwise(F.round(x, digits)))
