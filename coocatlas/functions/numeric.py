"""Numeric expressions with fixed semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logcount(count: Column) -> Column:
    return F.log10(count.cast("double")).cast("float")


def keep_probability(count: Column, total: Column, threshold: float) -> Column:
    """Chance of keeping one occurrence of an item under frequency subsampling."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(threshold) / (count.cast("double") / total)))


def noise_weight(count: Column) -> Column:
    """Unnormalised weight of an item as a negative sample."""
    return F.pow(count.cast("double"), F.lit(0.75))


def list_count(n: Column) -> Column:
    """Number of inverted lists for n vectors."""
    raw = F.floor(F.lit(4.0) * F.sqrt(n.cast("double")))
    return F.least(F.greatest(raw, F.lit(256)), F.lit(16384)).cast("int")


def train_size(n: Column) -> Column:
    """Number of vectors the coarse centroids are trained on."""
    return F.least(n.cast("bigint"), F.lit(64) * list_count(n).cast("bigint"))


def default_popfloor(logcount_column: Column) -> Column:
    """Popularity floor proposed for a seed: two decades below it, never negative."""
    return F.greatest(F.floor(logcount_column.cast("double") - 2 + 0.5), F.lit(0)).cast("int")


def type_priority(album_type: Column) -> Column:
    """Full albums first, then EPs, then everything else including unknown."""
    kind = F.lower(F.coalesce(album_type, F.lit("")))
    return F.when(kind == "album", 0).when(kind == "ep", 1).otherwise(2)


def scale_axis(value: Column, low: Column, high: Column, half_width: float) -> Column:
    """Map [low, high] to [-half_width, half_width]; a negative half width mirrors the axis."""
    unit = (value.cast("double") - low) / (high - low)
    return F.bround(unit * F.lit(2.0 * half_width) - F.lit(half_width), 6).cast("float")


def tms_flip(zoom: Column, row: Column) -> Column:
    """Turn a bottom-up tile row into a top-down one, and back."""
    return F.pow(F.lit(2), zoom).cast("bigint") - 1 - row
