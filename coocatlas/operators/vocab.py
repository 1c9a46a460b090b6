"""Vocabulary: interaction scan, counts, thresholds, statistics, enrichment and chunk export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas import schema
from coocatlas.operators.ids import dense_index, dictionary, per_key
from coocatlas.operators.quality import conform

EXPORT_FILTERS = "is_episode=0, is_local=0, track_rowid IS NOT NULL"


def usable_interactions(interactions: DataFrame) -> DataFrame:
    """Interactions with a catalogue track; the predicates reach the parquet scan."""
    return interactions.where(~F.col("is_episode") & ~F.col("is_local") & F.col("track_rowid").isNotNull())


def playlist_counts(interactions: DataFrame) -> DataFrame:
    """Number of distinct playlists per track.

    Distinct pairs first, then a plain count: both steps combine before their
    shuffle, so a track present in a third of all playlists stays cheap.
    """
    pairs = usable_interactions(interactions).select("playlist_rowid", "track_rowid").distinct()
    return pairs.groupBy("track_rowid").agg(F.count("*").cast("int").alias("playlist_count"))


def chunked_counts(chunk_rows: DataFrame) -> DataFrame:
    """Distinct-playlist counts summed over chunks; playlists never span chunks."""
    pairs = chunk_rows.select("chunk_id", "playlist_rowid", "track_rowid").distinct()
    per_chunk = pairs.groupBy("chunk_id", "track_rowid").agg(F.count("*").alias("n"))
    return per_chunk.groupBy("track_rowid").agg(F.sum("n").cast("int").alias("playlist_count"))


def threshold(counts: DataFrame, min_count: int) -> DataFrame:
    if min_count < 1:
        raise ValueError("min_count must be >= 1")
    return counts.where(F.col("playlist_count") >= min_count)


def build_vocab(counts: DataFrame, min_count: int) -> DataFrame:
    """Counts above the threshold with dense track ids in key order; also re-densifies a vocabulary."""
    kept = threshold(counts.select("track_rowid", "playlist_count"), min_count)
    return conform(dense_index(kept, "track_rowid", name="track_id"), schema.VOCAB)


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """One row of size and distribution figures; percentiles interpolate linearly.

    Works on (count, frequency) pairs, so the exact percentile sees at most one row
    per distinct count rather than one per track.
    """
    freq = vocab.groupBy("playlist_count").agg(F.count("*").alias("f"))
    at = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    return freq.agg(
        F.sum("f").alias("vocab_size"),
        F.sum(F.col("playlist_count") * F.col("f")).alias("total_count"),
        F.min("playlist_count").alias("min_count"),
        *[F.percentile("playlist_count", F.lit(p), F.col("f")).alias(n) for n, p in at.items()],
        (F.sum(F.col("playlist_count") * F.col("f")) / F.sum("f")).alias("mean"),
        F.max("playlist_count").alias("max_count"),
    )


def first_child(links: DataFrame, parent: str, child: str, ordinal: Column | str) -> DataFrame:
    """One child per parent, the one with the lowest ordinal."""
    return links.groupBy(parent).agg(F.min_by(child, ordinal).alias(child))


def primary_artists(track_artists: DataFrame) -> DataFrame:
    return first_child(track_artists, "track_rowid", "artist_rowid", F.struct("ordinal", "artist_rowid"))


def primary_genres(artist_genres: DataFrame) -> DataFrame:
    return first_child(artist_genres, "artist_rowid", "genre", F.struct("ordinal", "genre")).withColumnRenamed(
        "genre", "artist_genre"
    )


def vocab_metadata(vocab: DataFrame, tracks: DataFrame, albums: DataFrame, track_artists: DataFrame) -> DataFrame:
    """Vocabulary with album, label text, external id and primary artist; inner joins throughout."""
    ids = tracks.select("track_rowid", "album_rowid", F.col("external_id_isrc").alias("id_isrc"))
    return (
        vocab.join(per_key(ids), "track_rowid")
        .join(albums.select("album_rowid", "label"), "album_rowid")
        .join(per_key(primary_artists(track_artists)), "track_rowid")
    )


def enrich_vocab(vocab: DataFrame, tracks: DataFrame, albums: DataFrame, track_artists: DataFrame) -> DataFrame:
    """Attach artist, album and label ids to a vocabulary.

    Label ids come from the sorted distinct labels in use, starting at 1; tracks
    with a null or empty label keep a null id.
    """
    joined = vocab_metadata(vocab, tracks, albums, track_artists)
    # the labels in use need no artists, which would put the whole link table in front of the dictionary
    used = tracks.join(per_key(vocab.select("track_rowid")), "track_rowid", "left_semi").select("album_rowid").distinct()
    labels = dictionary(albums.join(used, "album_rowid", "left_semi"), "label", "label_rowid")
    return conform(joined.join(labels, "label", "left"), schema.ENRICHED_VOCAB)


def playlist_slice(playlists: DataFrame, offset: int = 0) -> DataFrame:
    """Playlist keys in order, numbered from 0 after a Python-style slice.

    0 keeps all, K drops the first K, -K keeps the last K.
    """
    indexed = dense_index(playlists.select("playlist_rowid"), "playlist_rowid", name="idx")
    if offset == 0:
        return indexed
    total = playlists.count()
    if not -(total - 1) <= offset <= total - 1:
        raise ValueError(f"offset {offset} out of range for {total} playlists")
    first = offset if offset > 0 else total + offset
    return indexed.where(F.col("idx") >= first).withColumn("idx", F.col("idx") - first)


def assign_chunks(playlists: DataFrame, interactions: DataFrame, chunk_size: int, offset: int = 0) -> DataFrame:
    """Usable interactions of the selected playlists, tagged with their chunk."""
    chunks = playlist_slice(playlists, offset).select(
        "playlist_rowid", F.floor(F.col("idx") / chunk_size).cast("int").alias("chunk_id")
    )
    columns = schema.CHUNK_ROWS.fieldNames()
    rows = conform(usable_interactions(interactions).select(*columns), schema.CHUNK_ROWS)
    return rows.join(chunks, "playlist_rowid").select("chunk_id", *columns)


def export_chunks(chunk_rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write one folder per chunk; chunks already present are skipped unless overwriting.

    Rebalancing on the chunk keeps small chunks in one file and splits one that a
    huge playlist has swollen.
    """
    spark = chunk_rows.sparkSession
    if not overwrite:
        present = _written_chunks(spark, path)
        if present is not None:
            chunk_rows = chunk_rows.join(present, "chunk_id", "left_anti")
    writer = chunk_rows.hint("rebalance", F.col("chunk_id")).write.partitionBy("chunk_id")
    if overwrite:
        writer.mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)


def _written_chunks(spark, path: str) -> DataFrame | None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.schema("chunk_id INT").parquet(path).select("chunk_id").distinct()


def chunk_manifest(playlists: DataFrame, chunk_size: int, offset: int = 0) -> DataFrame:
    """One row describing an export; write it with ``coalesce(1).write.json``."""
    total = F.count("*")
    kept = total - offset if offset >= 0 else F.lit(-offset).cast("bigint")
    outside = F.raise_error(F.concat(F.lit(f"offset {offset} out of range for "), total.cast("string"), F.lit(" playlists")))
    # as in playlist_slice, an offset must leave at least one playlist
    selected = kept if offset == 0 else F.when(total > abs(offset), kept).otherwise(outside.cast("bigint"))
    return playlists.agg(selected.alias("total_playlists")).select(
        F.ceil(F.col("total_playlists") / chunk_size).cast("bigint").alias("total_chunks"),
        F.lit(chunk_size).alias("playlists_per_chunk"),
        "total_playlists",
        F.lit(offset).alias("offset"),
        F.lit(",".join(schema.CHUNK_ROWS.fieldNames())).alias("columns"),
        F.lit(EXPORT_FILTERS).alias("filters"),
    )
