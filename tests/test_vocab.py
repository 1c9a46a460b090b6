import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas import schema
from coocatlas.operators import ids, quality, vocab


def interactions(spark, pairs):
    data = [(p, t, i, None, None, episode, local) for i, (p, t, episode, local) in enumerate(pairs)]
    return spark.createDataFrame(data, schema.INTERACTIONS)


def test_counts_are_distinct_and_filtered(spark):
    df = interactions(
        spark,
        [(1, 10, False, False), (1, 10, False, False), (2, 10, False, False), (3, 10, True, False),
         (4, 10, False, True), (1, None, False, False), (1, 20, False, False)],
    )
    assert rows(vocab.playlist_counts(df)) == [(10, 2), (20, 1)]


def test_hot_track_keeps_all_its_playlists(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("playlist_rowid"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("track_rowid"),
        F.lit(False).alias("is_episode"), F.lit(False).alias("is_local"),
    )
    top = vocab.playlist_counts(df).orderBy(F.desc("playlist_count")).first()
    # playlist 7 itself also holds track 7
    assert tuple(top) == (7, 10_001)


def test_build_vocab(spark):
    counts = spark.createDataFrame([(30, 5), (10, 9), (20, 1)], "track_rowid BIGINT, playlist_count INT")
    built = vocab.build_vocab(counts, 2)
    assert built.schema.simpleString() == schema.VOCAB.simpleString()
    assert rows(built) == [(10, 0, 9), (30, 1, 5)]
    with pytest.raises(ValueError):
        vocab.build_vocab(counts, 0)


def test_dense_index_over_many_partitions(spark):
    df = spark.range(0, 50_000, 7).repartition(11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(ids.dense_index(df, "id", start=3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == [(i * 7, i + 3) for i in range(len(got))]


def test_dense_index_of_nothing(spark):
    assert rows(ids.dense_index(spark.range(0), "id")) == []


def test_dictionary_is_in_code_point_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("é",), (None,), ("",), ("a",), ("b",)], "label STRING")
    assert sorted(rows(ids.dictionary(df, "label", "id")), key=lambda r: r[1]) == [("B", 1), ("a", 2), ("b", 3), ("é", 4)]


def test_take_first_agrees_between_merged_and_ranked(spark, monkeypatch):
    df = spark.range(2000).withColumn("v", F.col("id") % 7)
    small = rows(ids.take_first(df, 100, F.desc("v"), "id"))
    monkeypatch.setattr(ids, "MERGED_LIMIT", 10)
    assert rows(ids.take_first(df, 100, F.desc("v"), "id")) == small
    assert len(small) == 100


def test_exact_sample_is_exact_and_stable(spark):
    df = spark.range(1000)
    a = rows(ids.exact_sample(df, "id", 137, 1))
    assert len(a) == 137 and a == rows(ids.exact_sample(df.repartition(5), "id", 137, 1))
    assert a != rows(ids.exact_sample(df, "id", 137, 2))
    assert len(rows(ids.exact_sample(df, "id", 5000, 1))) == 1000
    part, rest = ids.split_off(df, "id", 137, 1)
    assert rows(part.union(rest)) == rows(df)


@pytest.mark.parametrize("fraction,expected", [(0.0, 0), (0.01, 1), (0.25, 2), (0.5, 5)])
def test_split_chunks(spark, fraction, expected):
    chunks = spark.range(10).select(F.col("id").cast("int").alias("chunk_id"))
    split = ids.split_chunks(chunks, fraction, 42)
    assert split.count() == 10 and split.where("is_valid").count() == expected


def test_seeded_shuffle_keeps_rows_and_changes_order(spark):
    df = spark.range(1000).coalesce(1)
    first = [r[0] for r in ids.seeded_shuffle(df, 1, 0, "id").collect()]
    assert sorted(first) == list(range(1000)) and first != sorted(first)
    assert first == [r[0] for r in ids.seeded_shuffle(df.repartition(7), 1, 0, "id").collect()]
    assert first != [r[0] for r in ids.seeded_shuffle(df, 1, 1, "id").collect()]


def test_vocab_stats(spark):
    df = spark.createDataFrame([(i, i, c) for i, c in enumerate([1, 2, 2, 5])], schema.VOCAB)
    s = vocab.vocab_stats(df).first()
    assert (s.vocab_size, s.total_count, s.min_count, s.median, s.mean, s.max_count) == (4, 10, 1, 2.0, 2.5, 5)
    assert s.p95 == pytest.approx(4.55) and s.p99 == pytest.approx(4.91)


def test_playlist_slice(spark):
    df = spark.createDataFrame([(5,), (3,), (9,), (7,)], "playlist_rowid BIGINT")
    assert rows(vocab.playlist_slice(df)) == [(3, 0), (5, 1), (7, 2), (9, 3)]
    assert rows(vocab.playlist_slice(df, 1)) == [(5, 0), (7, 1), (9, 2)]
    assert rows(vocab.playlist_slice(df, -1)) == [(9, 0)]
    for offset in (4, -4):
        with pytest.raises(ValueError):
            vocab.playlist_slice(df, offset)


def test_chunk_export_skips_and_overwrites(spark, tmp_path):
    playlists = spark.createDataFrame([(1,), (2,), (3,)], "playlist_rowid BIGINT")
    df = interactions(spark, [(1, 10, False, False), (2, 20, False, False), (3, 30, False, False), (9, 1, False, False)])
    chunks = vocab.assign_chunks(playlists, df, 2)
    assert rows(chunks, "chunk_id", "playlist_rowid") == [(0, 1), (0, 2), (1, 3)]
    path = str(tmp_path / "chunks")
    vocab.export_chunks(chunks.where("chunk_id = 0"), path)
    vocab.export_chunks(chunks, path)
    vocab.export_chunks(chunks, path)
    assert rows(spark.read.parquet(path), "chunk_id", "track_rowid") == [(0, 10), (0, 20), (1, 30)]
    vocab.export_chunks(chunks.where("chunk_id = 1"), path, overwrite=True)
    assert rows(spark.read.parquet(path), "chunk_id", "track_rowid") == [(1, 30)]


def test_chunked_counts_equal_plain_counts(spark):
    playlists = spark.range(20).select(F.col("id").alias("playlist_rowid"))
    df = interactions(spark, [(p, t, False, False) for p in range(20) for t in range(p % 5 + 1)])
    chunks = vocab.assign_chunks(playlists, df, 3)
    assert rows(vocab.chunked_counts(chunks)) == rows(vocab.playlist_counts(df))


def test_chunk_manifest(spark):
    playlists = spark.range(10).select(F.col("id").alias("playlist_rowid"))
    for offset, total, chunks in ((0, 10, 4), (4, 6, 2), (-5, 5, 2)):
        m = vocab.chunk_manifest(playlists, 3, offset).first()
        assert (m.total_playlists, m.total_chunks, m.offset) == (total, chunks, offset)


def test_enrich_vocab(spark):
    base = spark.createDataFrame([(1, 0, 5), (2, 1, 6), (3, 2, 7)], schema.VOCAB)
    tracks = spark.createDataFrame(
        [(1, "X1", 11), (2, None, 12), (3, "X3", 11), (4, "X4", 11)], "track_rowid BIGINT, external_id_isrc STRING, album_rowid BIGINT"
    )
    albums = spark.createDataFrame([(11, "zeta"), (12, "")], "album_rowid BIGINT, label STRING")
    links = spark.createDataFrame(
        [(1, 100, 1), (1, 101, 0), (2, 100, 5), (3, 102, 1), (3, 99, 2)], "track_rowid BIGINT, artist_rowid BIGINT, ordinal INT"
    )
    got = vocab.enrich_vocab(base, tracks, albums, links)
    assert got.schema.simpleString() == schema.ENRICHED_VOCAB.simpleString()
    assert rows(got) == [(1, 0, 5, 101, 11, 1, "X1"), (2, 1, 6, 100, 12, None, None), (3, 2, 7, 102, 11, 1, "X3")]


def test_primary_genre_is_the_first(spark):
    df = spark.createDataFrame([(1, "rock", 0), (1, "indie", 1), (2, "jazz", 3)], "artist_rowid BIGINT, genre STRING, ordinal INT")
    assert rows(vocab.primary_genres(df)) == [(1, "rock"), (2, "jazz")]


def test_key_coverage(spark):
    want = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    have = spark.createDataFrame([(2,), (2,), (3,), (4,)], "k INT")
    assert rows(quality.key_coverage(want, have, "k")) == [("duplicate", 2), ("extra", 4), ("missing", 1)]
    with pytest.raises(ValueError, match="missing 1"):
        quality.require_coverage(want, have, "k")
    quality.require_coverage(want, want, "k")


def test_conform_needs_every_column(spark):
    with pytest.raises(ValueError, match="track_id"):
        quality.conform(spark.range(1).withColumnRenamed("id", "track_rowid"), schema.VOCAB)


def test_required_columns(spark):
    df = spark.createDataFrame([(1, " ", 1.0), (2, "x", None), (3, None, 2.0)], "id INT, name STRING, lon DOUBLE")
    assert rows(quality.blank_counts(df, ["name", "lon"])) == [("lon", 1), ("name", 2)]
    with pytest.raises(ValueError, match=r"albums: required columns contain null/empty values: name=2, lon=1"):
        quality.require_columns(df, ["name", "lon"], "albums")
    with pytest.raises(ValueError, match="albums: missing required columns: gone"):
        quality.require_columns(df, ["name", "gone"], "albums")
    assert quality.require_columns(df, ["id"], "albums") is df
