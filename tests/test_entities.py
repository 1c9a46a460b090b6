import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas import schema
from coocatlas.operators import entities


@pytest.fixture
def vocab(spark):
    data = [
        (10, 0, 10, 1, 11, 111, "a"), (20, 1, 100, 1, 11, 111, "b"), (30, 2, 50, 1, 11, None, "c"),
        (40, 3, 1000, 2, 22, 222, "d"),
    ]
    return spark.createDataFrame(data, schema.ENRICHED_VOCAB)


@pytest.fixture
def trained(spark):
    data = [(10, [1.0, 1.5]), (20, [2.0, 2.5]), (30, [3.0, 3.5])]
    return spark.createDataFrame(data, "track_rowid BIGINT, embedding ARRAY<FLOAT>")


@pytest.fixture
def valid(vocab, trained):
    return entities.valid_tracks(vocab, trained)


def test_valid_tracks(valid):
    assert rows(valid, "track_rowid") == [(10,), (20,)]


def test_track_popularity(valid):
    assert rows(entities.track_popularity(valid)) == [(10, 1.0), (20, 2.0)]


@pytest.mark.parametrize("group", ["artist_rowid", "album_rowid", "label_rowid"])
def test_group_thresholds(valid, group):
    assert entities.valid_group_tracks(valid, group, 2).count() == 2
    assert entities.valid_group_tracks(valid, group, 3).count() == 0
    (got,) = entities.group_popularity(valid, group, 2, {"nalbum": "album_rowid"}).collect()
    assert got["logcount"] == np.float32(np.log10(110)) and (got["ntrack"], got["nalbum"]) == (2, 1)
    assert entities.group_popularity(valid, group, 3).count() == 0


def test_pooled_vectors(valid, trained):
    assert rows(entities.pool_vectors(valid, trained, "artist_rowid", 2)) == [(1, [1.5, 2.0])]
    assert entities.pool_vectors(valid, trained, "artist_rowid", 3).count() == 0
    assert rows(entities.track_vectors(valid, trained)) == [(10, [1.0, 1.5]), (20, [2.0, 2.5])]


def test_first_known_skips_nulls_per_column(spark):
    df = spark.createDataFrame(
        [(1, 3, "c", None), (1, 1, None, None), (1, 2, "b", "y"), (2, 5, None, None)],
        "g INT, track_rowid INT, a STRING, b STRING",
    )
    got = df.groupBy("g").agg(entities.first_known("a"), entities.first_known("b"))
    assert rows(got) == [(1, "b", "y"), (2, None, None)]


def test_lookups(spark, vocab, valid):
    artists = spark.createDataFrame([(1, "Artist One"), (2, "Artist Two")], "artist_rowid BIGINT, name STRING")
    albums = spark.createDataFrame(
        [(11, "Album", "Label", "album", 9, "1959", "year"), (22, "Other", "L2", None, None, None, None)],
        "album_rowid BIGINT, name STRING, label STRING, album_type STRING, total_tracks INT, release_date STRING, "
        "release_date_precision STRING",
    )
    tracks = spark.createDataFrame(
        [(10, "Ten", None, "a", 11), (20, "Twenty", 55, "b", 11), (30, "Thirty", 1, "c", 11), (40, "Forty", 2, "d", 22)],
        "track_rowid BIGINT, name STRING, popularity INT, external_id_isrc STRING, album_rowid BIGINT",
    )
    links = spark.createDataFrame(
        [(10, 1, 0), (20, 1, 0), (30, 1, 0), (40, 2, 0)], "track_rowid BIGINT, artist_rowid BIGINT, ordinal INT"
    )
    genres = spark.createDataFrame([(1, "rock", 0), (1, "indie", 1)], "artist_rowid BIGINT, genre STRING, ordinal INT")
    meta = entities.track_metadata(valid, tracks, albums, artists, links, genres)
    assert rows(meta, "track_rowid", "track_popularity", "artist_genre", "release_date") == [
        (10, 0, "rock", "1959"), (20, 55, "rock", "1959"),
    ]
    track = entities.track_lookup(valid, meta)
    assert track.columns == schema.TRACK_LOOKUP.fieldNames()
    assert rows(track, "track_rowid", "label_rowid", "logcount") == [(10, 111, 1.0), (20, 111, 2.0)]
    pop = np.float32(np.log10(110)).item()
    assert rows(entities.artist_lookup(valid, meta, 2)) == [(1, "Artist One", "rock", pop, 2, 1)]
    assert rows(entities.album_lookup(vocab, valid, meta, 2)) == [
        (11, "Album", 1, 111, "Label", "Artist One", "album", "1959", "year", pop, 9)
    ]
    assert rows(entities.label_lookup(vocab, valid, meta, 2)) == [(111, "Label", pop, 2, 1, 1)]


def test_tables_with_a_row_per_track_are_merged(spark, vocab, valid, trained, tmp_path):
    """Both sides grow with the tracks, so neither is sent whole to the driver, however small its files."""
    def written(name, frame):
        frame.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    vocab, valid, trained = written("vocab", vocab), written("valid", valid), written("trained", trained)
    made = [entities.valid_tracks(vocab, trained), entities.track_vectors(valid, trained), entities.pool_vectors(valid, trained, "artist_rowid", 1)]
    for frame in made:
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
