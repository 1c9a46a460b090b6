"""Expressions on array vectors. Sums run in double; results are cast last."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.functions.let import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Divide each vector by its length (at least 1e-12); float result."""

    def scaled(length: Column) -> Column:
        return F.transform(column, lambda x: (x.cast("double") / length).cast("float"))

    return df.withColumn(column, let(F.greatest(norm(F.col(column)), F.lit(1e-12)), scaled))


def to_wide(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Spread a vector column over e0..e{dim-1}."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, *[F.col(column)[i].cast("float").alias(f"e{i}") for i in range(dim)])


def wide_columns(df: DataFrame) -> list[str]:
    """The vector columns of a wide table in dimension order."""
    found = [c for c in df.columns if re.fullmatch(r"e\d+", c)]
    return sorted(found, key=lambda c: int(c[1:]))


def from_wide(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Gather e0..e{dim-1} into one vector column."""
    wide = wide_columns(df)
    if not wide:
        raise ValueError("no vector columns e0, e1, ... in the table")
    rest = [c for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in wide]).alias(column))
