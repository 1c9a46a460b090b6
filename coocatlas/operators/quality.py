"""Data-quality operators: schema conformance, key checks, required columns and the gate on a guarantee report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coocatlas.functions.text import is_blank
from coocatlas.schema import ALBUM, ARTIST, LABEL, TRACK


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Select and cast to a declared schema; a missing column fails while the plan is built."""
    missing = [name for name in target.fieldNames() if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) for keys found more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def key_coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(problem, key) rows: duplicate, missing and extra keys of ``actual`` against ``expected``."""
    duplicate = duplicate_keys(actual, key).select(F.lit("duplicate").alias("problem"), key)
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    missing = want.join(have, key, "left_anti").select(F.lit("missing").alias("problem"), key)
    extra = have.join(want, key, "left_anti").select(F.lit("extra").alias("problem"), key)
    return duplicate.unionByName(missing).unionByName(extra)


def require_coverage(expected: DataFrame, actual: DataFrame, key: str) -> None:
    """Raise with up to five offending keys if ``actual`` does not hold exactly the expected keys."""
    rows = key_coverage(expected, actual, key).orderBy("problem", key).limit(5).collect()
    if rows:
        raise ValueError("key coverage: " + ", ".join(f"{r['problem']} {r[key]}" for r in rows))


def coverage_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two tables and whether they agree."""
    a = left.agg(F.count("*").alias("left_rows"))
    b = right.agg(F.count("*").alias("right_rows"))
    return a.crossJoin(b).withColumn("ok", F.col("left_rows") == F.col("right_rows"))


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, blanks) per required column, counted in one pass; an absent column fails first."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    counted = df.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("blanks")) for c in columns])
    return counted.select(F.inline(pairs))


def require_columns(df: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every column with null or blank values."""
    try:
        bad = blank_counts(df, columns).where("blanks > 0").collect()
    except ValueError as error:
        raise ValueError(f"{entity}: {error}") from None
    if bad:
        found = ", ".join(f"{r['column']}={r['blanks']}" for r in bad)
        raise ValueError(f"{entity}: required columns contain null/empty values: {found}")
    return df


def is_subset(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys of ``left`` are absent from ``right``."""
    have = right.select(key).where(F.col(key).isNotNull())
    return left.select(key).distinct().join(have, key, "left_anti").agg(F.count("*").alias("violations"))


# Fixed list: the name columns that must not be empty, and whether an empty one is tolerated.
NAME_COLUMNS = (
    ("track_name", TRACK, True),
    ("track_name_norm", TRACK, True),
    ("album_name", TRACK, False),
    ("artist_name", TRACK, False),
    ("label", TRACK, False),
    ("album_name", ALBUM, False),
    ("album_name_norm", ALBUM, False),
    ("artist_name", ALBUM, False),
    ("label", ALBUM, False),
    ("artist_name", ARTIST, False),
    ("label", LABEL, False),
)


def two_way(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys only on the left, and only on the right, from one join."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only")
    )


def require_guarantees(report: DataFrame) -> None:
    """Raise if a check failed that is not marked acceptable."""
    failed = [r["check"] for r in report.where("not ok and not acceptable").select("check").collect()]
    if failed:
        raise ValueError("failed guarantees: " + "; ".join(sorted(failed)))
