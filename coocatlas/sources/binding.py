"""Read the star-schema tables and present them as the catalogue model.

Orders act as playlists, line items as their entries, parts as tracks, (brand, type)
groups as albums, suppliers as artists and brands as labels. Every derived column is
an expression on one row, so the binding itself adds no shuffle (album sizes excepted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coocatlas import schema
from coocatlas.operators.quality import conform

# Album slot and album type per part type; title suffix per track.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ALBUM_TYPES = ("album", "album", "Album", "single", "ep", None)
ALBUM_SUFFIXES = ("", " (Deluxe)", " [Remastered Edition]", " - Live", " (Expanded)", "")
TRACK_SUFFIXES = ("", " (Deluxe)", " - Live", " [Remastered Edition]")
UNLABELLED_BRAND = "Brand#13"


@dataclass(frozen=True)
class Sources:
    """The relational tables an atlas is built from."""

    playlists: DataFrame
    interactions: DataFrame
    tracks: DataFrame
    albums: DataFrame
    artists: DataFrame
    track_artists: DataFrame
    artist_genres: DataFrame
    checkpoint: DataFrame


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(index: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int") + 1)


def _brand_number() -> Column:
    return F.substring_index("p_brand", "#", -1).cast("bigint")


def _type_slot() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")) - 1


def _epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _album_rowid() -> Column:
    return _brand_number() * 10 + _type_slot()


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("playlist_rowid"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("playlist_rowid"),
        F.col("l_partkey").alias("track_rowid"),
        F.col("l_linenumber").alias("position"),
        _epoch_seconds(F.col("l_shipdate")).alias("added_at"),
        F.col("l_suppkey").cast("string").alias("added_by_id"),
        (F.col("l_returnflag") == "R").alias("is_episode"),
        (F.col("l_tax") == 0).alias("is_local"),
    )
    return conform(rows, schema.INTERACTIONS)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_rowid"),
        F.concat("p_name", _pick(F.col("p_partkey") % 4, TRACK_SUFFIXES)).alias("name"),
        F.nullif(F.col("p_size"), F.lit(50)).alias("popularity"),
        F.concat(F.lit("ZZ"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("external_id_isrc"),
        _album_rowid().alias("album_rowid"),
    )


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").cast("int").alias("total_tracks"))
    brand, slot = _brand_number(), _type_slot()
    return sized.select(
        _album_rowid().alias("album_rowid"),
        F.concat(F.lit("Selection "), (brand % 3).cast("string"), _pick(slot, ALBUM_SUFFIXES)).alias("name"),
        F.when(F.col("p_brand") == UNLABELLED_BRAND, "").otherwise(F.col("p_brand")).alias("label"),
        _pick(slot, ALBUM_TYPES).alias("album_type"),
        "total_tracks",
        (F.lit(1990) + brand).cast("string").alias("release_date"),
        F.lit("year").alias("release_date_precision"),
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_rowid"), F.col("s_name").alias("name"))


def track_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("track_rowid"),
        F.col("l_suppkey").alias("artist_rowid"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ordinal"),
    )


def artist_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation first, region second; suppliers in debt have no genre."""
    supplier = read(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    genres = F.posexplode(F.array("n_name", "r_name")).alias("ordinal", "genre")
    return placed.select(F.col("s_suppkey").alias("artist_rowid"), genres)


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors, one per trained item."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_rowid"), "embedding")


def bind(spark: SparkSession, sf_dir: str) -> Sources:
    return Sources(
        playlists(spark, sf_dir),
        interactions(spark, sf_dir),
        tracks(spark, sf_dir),
        albums(spark, sf_dir),
        artists(spark, sf_dir),
        track_artists(spark, sf_dir),
        artist_genres(spark, sf_dir),
        checkpoint(spark, sf_dir),
    )
