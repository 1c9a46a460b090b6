"""Entities behind the vocabulary: validity, popularity, counts, pooled vectors, metadata and lookups."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas import schema
from coocatlas.functions.numeric import logcount
from coocatlas.operators.ids import per_key
from coocatlas.operators.quality import conform
from coocatlas.operators.vocab import primary_artists, primary_genres

ALBUM_COLUMNS = (
    "album_name", "artist_rowid", "artist_name", "label_rowid", "label", "album_type", "release_date",
    "release_date_precision", "total_tracks",
)


def valid_tracks(vocab: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Labelled vocabulary rows that have a vector."""
    return vocab.where(F.col("label_rowid").isNotNull()).join(per_key(checkpoint.select("track_rowid")), "track_rowid", "left_semi")


def valid_group_tracks(valid: DataFrame, group: str, min_tracks: int) -> DataFrame:
    """Valid tracks of groups with at least ``min_tracks`` of them."""
    large = valid.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= min_tracks)
    return valid.join(large.select(group), group, "left_semi")


def track_popularity(valid: DataFrame) -> DataFrame:
    return valid.select("track_rowid", logcount(F.col("playlist_count")).alias("logcount"))


def group_popularity(valid: DataFrame, group: str, min_tracks: int, distinct: dict[str, str] | None = None) -> DataFrame:
    """Popularity, track count and distinct counts of one entity, from its valid tracks.

    The threshold is on the aggregate itself, so it needs no second pass over the tracks.
    """
    counts = [F.countDistinct(column).cast("int").alias(name) for name, column in (distinct or {}).items()]
    return (
        valid.groupBy(group)
        .agg(
            logcount(F.sum("playlist_count")).alias("logcount"),
            F.count("*").cast("int").alias("ntrack"),
            *counts,
        )
        .where(F.col("ntrack") >= min_tracks)
    )


def track_vectors(valid: DataFrame, checkpoint: DataFrame) -> DataFrame:
    return checkpoint.join(per_key(valid.select("track_rowid")), "track_rowid", "left_semi").select(
        "track_rowid", F.col("embedding").cast("array<float>").alias("embedding")
    )


def pool_vectors(valid: DataFrame, checkpoint: DataFrame, group: str, min_tracks: int) -> DataFrame:
    """Mean vector per group; partial means combine before the shuffle."""
    member = valid.select("track_rowid", group).join(per_key(checkpoint), "track_rowid")
    pooled = member.groupBy(group).agg(
        Summarizer.mean(array_to_vector(F.col("embedding"))).alias("v"), F.count("*").alias("n")
    )
    mean = vector_to_array(F.col("v")).cast("array<float>")
    return pooled.where(F.col("n") >= min_tracks).select(group, mean.alias("embedding"))


def track_metadata(
    track_ids: DataFrame, tracks: DataFrame, albums: DataFrame, artists: DataFrame, track_artists: DataFrame,
    artist_genres: DataFrame,
) -> DataFrame:
    """Names, primary artist and genre, album and release of the given tracks.

    Primary artists already attached to ``track_ids`` are used as they are; otherwise
    they are found among the links of those tracks.
    """
    if "artist_rowid" in track_ids.columns:
        primary = track_ids.select("track_rowid", "artist_rowid")
    else:
        own = track_artists.join(track_ids.select("track_rowid"), "track_rowid", "left_semi")
        primary = track_ids.select("track_rowid").join(primary_artists(own), "track_rowid")
    album = albums.select(
        "album_rowid", F.col("name").alias("album_name"), "label", "total_tracks", "album_type", "release_date",
        "release_date_precision",
    )
    track = tracks.select(
        "track_rowid", F.col("name").alias("track_name"),
        F.coalesce("popularity", F.lit(0)).cast("smallint").alias("track_popularity"),
        F.col("external_id_isrc").alias("id_isrc"), "album_rowid",
    )
    return (
        primary.join(per_key(track), "track_rowid")
        .join(album, "album_rowid")
        .join(artists.select("artist_rowid", F.col("name").alias("artist_name")), "artist_rowid")
        .join(primary_genres(artist_genres), "artist_rowid", "left")
        .select(
            "track_rowid", "track_name", "track_popularity", "id_isrc", "artist_rowid", "artist_genre", "artist_name",
            "album_rowid", "album_name", "label", "total_tracks", "album_type", "release_date",
            "release_date_precision",
        )
    )


def first_known(column: str, order: str = "track_rowid") -> Column:
    """Value of the lowest-ordered row of a group that has one; nulls are passed over per column."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


def track_lookup(valid: DataFrame, metadata: DataFrame) -> DataFrame:
    popular = valid.select("track_rowid", "label_rowid", logcount(F.col("playlist_count")).alias("logcount"))
    return conform(metadata.join(per_key(popular), "track_rowid"), schema.TRACK_LOOKUP)


def artist_lookup(valid: DataFrame, metadata: DataFrame, min_tracks: int) -> DataFrame:
    stats = group_popularity(valid, "artist_rowid", min_tracks, {"nalbum": "album_rowid"})
    names = metadata.groupBy("artist_rowid").agg(first_known("artist_name"), first_known("artist_genre"))
    return conform(stats.join(per_key(names), "artist_rowid"), schema.ARTIST_LOOKUP)


def album_lookup(vocab: DataFrame, valid: DataFrame, metadata: DataFrame, min_tracks: int) -> DataFrame:
    stats = group_popularity(valid, "album_rowid", min_tracks)
    labelled = metadata.join(per_key(vocab.select("track_rowid", "label_rowid")), "track_rowid", "left")
    facts = labelled.groupBy("album_rowid").agg(*[first_known(c) for c in ALBUM_COLUMNS])
    return conform(stats.join(per_key(facts), "album_rowid"), schema.ALBUM_LOOKUP)


def label_lookup(vocab: DataFrame, valid: DataFrame, metadata: DataFrame, min_tracks: int) -> DataFrame:
    stats = group_popularity(valid, "label_rowid", min_tracks, {"nalbum": "album_rowid", "nartist": "artist_rowid"})
    names = (
        vocab.select("track_rowid", "label_rowid")
        .join(per_key(metadata.select("track_rowid", "label")), "track_rowid")
        .groupBy("label_rowid")
        .agg(first_known("label"))
    )
    return conform(stats.join(per_key(names), "label_rowid"), schema.LABEL_LOOKUP)
