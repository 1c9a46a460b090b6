"""Ranked representative children of albums, artists and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coocatlas.functions.numeric import type_priority
from coocatlas.schema import ALBUM, ARTIST, LABEL, Entity

# Scores are rounded here, so that the order floating sums are added in cannot decide a rank.
SCORE_DIGITS = 9


def _ranked(
    df: DataFrame, group: str, child: str, limit: int, *order: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Best ``limit`` rows per group; Spark keeps only that many per task before the shuffle."""
    position = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return (
        df.withColumn("_rn", position)
        .where(F.col("_rn") <= limit)
        .select(group, (F.col("_rn") - 1).alias("rank"), child, F.col("score").cast("double").alias("score"), *keep)
    )


def album_tracks(tracks: DataFrame, limit: int) -> DataFrame:
    """Top searchable tracks per album by popularity."""
    scored = tracks.where("searchable").select("album_rowid", "track_rowid", F.col("logcount").alias("score"))
    return _ranked(scored, "album_rowid", "track_rowid", limit, F.desc("score"), F.asc("track_rowid"))


def album_scores(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Median popularity of searchable tracks per canonical album."""
    via = albums.select("album_rowid", "album_canonical_rowid")
    return (
        tracks.where("searchable")
        .select("album_rowid", "logcount")
        .join(via, "album_rowid")
        .groupBy("album_canonical_rowid")
        .agg(F.percentile("logcount", F.lit(0.5)).alias("score"))
    )


def rank_artist_albums(scores: DataFrame, albums: DataFrame, limit: int) -> DataFrame:
    """Best albums per artist: only the artist's best release type, by score, popularity, id."""
    candidates = (
        albums.where("searchable")
        .join(scores.withColumnRenamed("album_canonical_rowid", "album_rowid"), "album_rowid")
        .select("artist_rowid", "album_rowid", "logcount", "score", type_priority(F.col("album_type")).alias("priority"))
    )
    # Ordered by release type first, the best type fills the top places; lesser types that
    # follow it there are dropped. Both windows share one shuffle.
    top = _ranked(
        candidates, "artist_rowid", "album_rowid", limit,
        F.asc("priority"), F.desc("score"), F.desc("logcount"), F.asc("album_rowid"), keep=("priority",),
    )
    best = F.min("priority").over(W.partitionBy("artist_rowid"))
    return top.withColumn("_best", best).where(F.col("priority") == F.col("_best")).drop("priority", "_best")


def artist_albums(tracks: DataFrame, albums: DataFrame, limit: int) -> DataFrame:
    return rank_artist_albums(album_scores(tracks, albums), albums, limit)


def damped_scores(tracks: DataFrame) -> DataFrame:
    """sum(popularity) / sqrt(tracks) per label and artist."""
    total = F.sum(F.col("logcount").cast("double")) / F.sqrt(F.count("logcount"))
    return tracks.groupBy("label_rowid", "artist_rowid").agg(F.round(total, SCORE_DIGITS).alias("score"))


def rank_label_artists(tracks: DataFrame, limit: int) -> DataFrame:
    """Best artists per label by damped score, then id."""
    return _ranked(damped_scores(tracks), "label_rowid", "artist_rowid", limit, F.desc("score"), F.asc("artist_rowid"))


def label_artists(tracks: DataFrame, artists: DataFrame, limit: int) -> DataFrame:
    visible = artists.where("searchable").select("artist_rowid")
    return rank_label_artists(tracks.where("searchable").join(visible, "artist_rowid", "left_semi"), limit)


def with_nrepr(table: DataFrame, links: DataFrame, entity: Entity) -> DataFrame:
    """Add the number of representatives, 0 for none."""
    counts = links.groupBy(entity.key).agg(F.count("*").cast("int").alias("nrepr"))
    return table.join(counts, entity.key, "left").withColumn("nrepr", F.coalesce("nrepr", F.lit(0)))


def repr_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, total, with_repr) for the three parents."""
    parts = [
        tables[e.table].agg(F.count("*").alias("total"), F.count_if(F.col("nrepr") > 0).alias("with_repr")).select(
            F.lit(e.table).alias("entity"), "total", "with_repr"
        )
        for e in (ALBUM, ARTIST, LABEL)
    ]
    return reduce(DataFrame.unionByName, parts)
