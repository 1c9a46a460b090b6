"""Text expressions: titles, keys, display strings and search ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix words that mark a release variant, and the shape of a variant suffix.
VARIANT_MARKERS = ("remaster", "edition", "version", "deluxe", "expanded", "anniversary")
VARIANT_SUFFIX = r"(?U)^(.+?)(\s+-\s*[^()]*|\s*\[.*\]\s*|\s*\([^()]*\)\s*)$"
NO_TRACK_NAME = "[no track name]"
SEARCH_ID = r"^(track|album|artist|label)_(\d+)$"


def squeeze(text: Column) -> Column:
    """Trim and collapse runs of any Unicode white space to one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Title without a trailing edition suffix; dots and white space collapsed."""
    cleaned = F.regexp_replace(squeeze(title), r"\.{3,}", "..")
    suffix = F.lower(F.regexp_extract(cleaned, VARIANT_SUFFIX, 2))
    marked = reduce(lambda a, b: a | b, [suffix.contains(word) for word in VARIANT_MARKERS])
    return F.when(marked, F.rtrim(F.regexp_extract(cleaned, VARIANT_SUFFIX, 1))).otherwise(cleaned)


def fold_key(text: Column) -> Column:
    """Case-folded, stripped comparison key.

    Upper before lower makes sharp s equal ss; stripping in between keeps the two
    conversions from being merged into one.
    """
    return F.lower(F.regexp_replace(F.upper(text), r"(?U)^\s+|\s+$", ""))


def is_blank(column: Column) -> Column:
    """Null, or nothing but white space."""
    return column.isNull() | (squeeze(column.cast("string")) == "")


def human_count(n: Column) -> Column:
    """7436313 -> 7.4M, one decimal at most, whole numbers below a thousand unchanged.

    The quotient is rounded on its exact binary value, ties upwards; a tie at one
    decimal is exact only for fractions .25 and .75, and half-even covers .75.
    """

    def scaled(unit: float, suffix: str) -> Column:
        x = n.cast("double") / unit
        up = F.when(x - F.floor(x) == 0.25, x + 0.05).otherwise(x)
        return F.concat(F.call_function("format_number", up, F.lit("0.#")), F.lit(suffix))

    return (
        F.when(n >= 1e9, scaled(1e9, "B"))
        .when(n >= 1e6, scaled(1e6, "M"))
        .when(n >= 1e3, scaled(1e3, "K"))
        .otherwise(n.cast("bigint").cast("string"))
    )


def playlist_count_text(logcount: Column) -> Column:
    """Approximate playlist count behind a popularity, for display."""
    return F.concat(human_count(F.round(F.pow(F.lit(10.0), logcount.cast("double")))), F.lit(" playlists"))


def display_track_name(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_TRACK_NAME))


def search_id(entity_name: str | Column, rowid: Column) -> Column:
    prefix = F.lit(entity_name) if isinstance(entity_name, str) else entity_name
    return F.concat_ws("_", prefix, rowid.cast("string"))


def parse_search_id(column: Column) -> Column:
    """Struct (entity_type, rowid); anything that is not a search id fails the query."""
    return F.when(
        column.rlike(SEARCH_ID),
        F.struct(
            F.regexp_extract(column, SEARCH_ID, 1).alias("entity_type"),
            F.regexp_extract(column, SEARCH_ID, 2).cast("bigint").alias("rowid"),
        ),
    ).otherwise(F.raise_error(F.concat(F.lit("invalid search id: "), F.coalesce(column, F.lit("null")))))


def words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text, in order."""
    split = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(split, lambda word: word != "")
