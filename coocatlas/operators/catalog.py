"""Serving tables: denormalised entities, canonical duplicates and visibility flags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.functions.text import normalize_title
from coocatlas.operators.ids import per_key
from coocatlas.schema import ALBUM, ARTIST, ENTITIES, LABEL, TRACK, Entity

# The columns of the serving tables, in their order, and those that must not be blank.
LABEL_COLUMNS = (
    "label_rowid", "label_canonical_rowid", "label", "logcount", "ntrack", "nalbum", "nartist", "lon", "lat",
)
ARTIST_COLUMNS = (
    "artist_rowid", "artist_canonical_rowid", "artist_name", "artist_genre", "logcount", "ntrack", "nalbum", "lon", "lat",
)
ALBUM_COLUMNS = (
    "album_rowid", "album_canonical_rowid", "album_name", "album_name_norm", "logcount", "lon", "lat",
    "artist_rowid", "artist_name", "artist_lon", "artist_lat", "artist_logcount", "album_type", "label",
    "total_tracks", "release_date", "release_date_precision", "label_rowid", "label_lon", "label_lat",
    "label_logcount",
)
TRACK_COLUMNS = (
    "track_rowid", "track_canonical_rowid", "track_name", "track_name_norm", "track_popularity", "logcount",
    "release_date", "id_isrc", "lon", "lat", "artist_rowid", "artist_name", "artist_lon", "artist_lat",
    "artist_logcount", "album_rowid", "album_name", "album_name_norm", "album_lon", "album_lat", "album_logcount",
    "label_rowid", "label", "label_lon", "label_lat", "label_logcount",
)
REQUIRED_ALBUM = (
    "artist_name", "artist_lon", "artist_lat", "artist_logcount", "label", "label_lon", "label_lat", "label_logcount",
)
REQUIRED_TRACK = REQUIRED_ALBUM + ("album_name", "album_name_norm", "album_lon", "album_lat", "album_logcount")


@dataclass(frozen=True)
class Thresholds:
    """Visibility thresholds of the serving tables."""

    track_logcount: float
    album_total_tracks: int
    artist_ntrack: int
    label_nartist: int
    recable_track_logcount: float


def _wide(df: DataFrame) -> DataFrame:
    """Coordinates and popularity in double, as the serving tables hold them."""
    wide = [c for c in ("logcount", "lon", "lat") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("double") for c in wide})


def parent_ref(table: DataFrame, parent: Entity, *extra: str) -> DataFrame:
    """Key, position and popularity of a parent, renamed for its children."""
    return table.select(
        parent.key, *extra, *[F.col(c).alias(f"{parent.name}_{c}") for c in ("lon", "lat", "logcount")]
    )


def build_labels(lookup: DataFrame, geo: DataFrame) -> DataFrame:
    placed = _wide(lookup.join(per_key(geo), LABEL.key))
    return placed.withColumn(LABEL.canonical_key, F.col(LABEL.key)).select(*LABEL_COLUMNS)


def build_artists(lookup: DataFrame, geo: DataFrame) -> DataFrame:
    placed = _wide(lookup.join(per_key(geo), ARTIST.key))
    return placed.withColumn(ARTIST.canonical_key, F.col(ARTIST.key)).select(*ARTIST_COLUMNS)


def build_albums(lookup: DataFrame, geo: DataFrame, artists: DataFrame, labels: DataFrame) -> DataFrame:
    """Placed albums with their artist and label; a missing parent leaves nulls for the column check."""
    return (
        _wide(lookup.join(per_key(geo), ALBUM.key))
        .join(parent_ref(artists, ARTIST), ARTIST.key, "left")
        .join(parent_ref(labels, LABEL), LABEL.key, "left")
        .withColumn("album_name_norm", normalize_title(F.col("album_name")))
        .withColumn(ALBUM.canonical_key, F.col(ALBUM.key))
        .select(*ALBUM_COLUMNS)
    )


def build_tracks(
    lookup: DataFrame, geo: DataFrame, artists: DataFrame, albums: DataFrame, labels: DataFrame
) -> DataFrame:
    return (
        _wide(lookup.join(per_key(geo), TRACK.key))
        .join(parent_ref(artists, ARTIST), ARTIST.key, "left")
        .join(parent_ref(albums, ALBUM, "album_name_norm"), ALBUM.key, "left")
        .join(parent_ref(labels, LABEL), LABEL.key, "left")
        .withColumn("track_name_norm", normalize_title(F.col("track_name")))
        .withColumn(TRACK.canonical_key, F.col(TRACK.key))
        .select(*TRACK_COLUMNS)
    )


def _elect(df: DataFrame, key: str, canonical: str, group: dict[str, Column]) -> DataFrame:
    """Set ``canonical`` to the smallest key of the row's duplicate group.

    An aggregate joined back instead of a window: the aggregate combines before its
    shuffle and a skewed group can be split in the join.
    """
    keyed = df.drop(canonical).withColumns(group)
    elected = keyed.groupBy(*group).agg(F.min(key).alias(canonical))
    # null keys form a group too
    renamed = elected.toDF(*(f"{name}_of" for name in group), canonical)
    same = [F.col(name).eqNullSafe(F.col(f"{name}_of")) for name in group]
    return keyed.join(per_key(renamed), same).drop(*group, *(f"{name}_of" for name in group))


def _title(column: str) -> Column:
    return F.lower(F.coalesce(column, F.lit("")))


def canonical_albums(albums: DataFrame) -> DataFrame:
    """Albums of one artist, type and case-insensitive normalised title share a canonical album."""
    group = {
        "_artist": F.col("artist_rowid"),
        "_type": F.coalesce("album_type", F.lit("")),
        "_title": _title("album_name_norm"),
    }
    return _elect(albums, ALBUM.key, ALBUM.canonical_key, group).select(*albums.columns)


def canonical_tracks(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Tracks of one canonical album and case-insensitive normalised title share a canonical track."""
    via = albums.select(ALBUM.key, F.col(ALBUM.canonical_key).alias("_album"))
    elected = _elect(
        tracks.join(via, ALBUM.key, "left"), TRACK.key, TRACK.canonical_key,
        {"_canonical": F.coalesce("_album", ALBUM.key), "_title": _title("track_name_norm")},
    )
    return elected.select(*tracks.columns)


def with_flags(table: DataFrame, entity: Entity, thresholds: Thresholds) -> DataFrame:
    """Add searchable and recable. Only self-canonical rows qualify; an unknown metric does not."""
    metric, least = {
        "track": ("logcount", thresholds.track_logcount),
        "album": ("total_tracks", thresholds.album_total_tracks),
        "artist": ("ntrack", thresholds.artist_ntrack),
        "label": ("nartist", thresholds.label_nartist),
    }[entity.name]
    canonical = F.col(entity.canonical_key) == F.col(entity.key)
    searchable = F.coalesce(canonical & (F.col(metric) >= least), F.lit(False))
    flagged = table.withColumn("searchable", searchable)
    recable = F.col("searchable")
    if entity == TRACK:
        recable = recable & (F.col("logcount") >= thresholds.recable_track_logcount)
    return flagged.withColumn("recable", recable)


def flag_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, total, searchable, recable) per table."""
    parts = [
        tables[e.table].agg(
            F.count("*").alias("total"),
            F.count_if("searchable").alias("searchable"),
            F.count_if("recable").alias("recable"),
        ).select(F.lit(e.table).alias("entity"), "total", "searchable", "recable")
        for e in ENTITIES
    ]
    return reduce(DataFrame.unionByName, parts)


def recable_ids(table: DataFrame, entity: Entity) -> DataFrame:
    """Ids offered as recommendations."""
    return table.where("recable").select(entity.key)
