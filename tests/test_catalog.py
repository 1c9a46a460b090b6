import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas.operators import catalog, guarantees, quality, reprs
from coocatlas.operators.catalog import Thresholds
from coocatlas.schema import ALBUM, ARTIST, ENTITIES, LABEL, TRACK


def albums(spark, data):
    return spark.createDataFrame(
        data, "album_rowid BIGINT, artist_rowid BIGINT, album_type STRING, album_name_norm STRING, album_canonical_rowid BIGINT"
    )


def test_album_canonical(spark):
    got = catalog.canonical_albums(
        albums(spark, [
            (201, 101, "album", "OK Computer", 201), (202, 101, "album", "ok computer", 202), (203, 101, "ep", "OK Computer", 203),
            (204, 102, "album", "OK Computer", 204), (205, 101, None, "Solo", 205), (206, 101, "", "Solo", 206),
        ])
    )
    assert rows(got, "album_rowid", "album_canonical_rowid") == [
        (201, 201), (202, 201), (203, 203), (204, 204), (205, 205), (206, 205),
    ]


def test_track_canonical_goes_through_the_canonical_album(spark):
    parents = albums(spark, [(201, 1, "album", "a", 201), (202, 1, "album", "a", 201)])
    tracks = spark.createDataFrame(
        [(1, 201, "Song", 1), (2, 201, "song", 2), (3, 202, "Song", 3), (4, 202, "Other", 4), (5, 999, "Song", 5)],
        "track_rowid BIGINT, album_rowid BIGINT, track_name_norm STRING, track_canonical_rowid BIGINT",
    )
    got = catalog.canonical_tracks(tracks, parents)
    assert rows(got, "track_rowid", "track_canonical_rowid") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_flags(spark):
    limits = catalog.Thresholds(2.0, 2, 10, 10, 3.0)
    tracks = spark.createDataFrame(
        [(1001, 1001, 3.5), (1002, 1002, 2.5), (1003, 1003, 3.0), (1004, 1003, 4.0), (1005, 1005, 1.0)],
        "track_rowid BIGINT, track_canonical_rowid BIGINT, logcount DOUBLE",
    )
    got = rows(catalog.with_flags(tracks, TRACK, limits), "track_rowid", "searchable", "recable")
    assert got == [(1001, True, True), (1002, True, False), (1003, True, True), (1004, False, False), (1005, False, False)]
    shelf = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, None)], "album_rowid BIGINT, album_canonical_rowid BIGINT, total_tracks INT")
    assert rows(catalog.with_flags(shelf, ALBUM, limits), "searchable", "recable") == [(False, False), (False, False), (True, True)]


def lookup_tables(spark):
    geo = lambda key, data: spark.createDataFrame(data, f"{key} BIGINT, lon FLOAT, lat FLOAT")
    label = spark.createDataFrame([(1, "L", 3.0, 5, 2, 2), (2, "M", 2.0, 1, 1, 1)], "label_rowid INT, label STRING, logcount FLOAT, ntrack INT, nalbum INT, nartist INT")
    artist = spark.createDataFrame([(10, "A", "rock", 3.0, 4, 1)], "artist_rowid BIGINT, artist_name STRING, artist_genre STRING, logcount FLOAT, ntrack INT, nalbum INT")
    album = spark.createDataFrame(
        [(20, "One (Deluxe)", 10, 1, "L", "A", "album", "1959", "year", 2.5, 8), (21, "Lost", 99, 1, "L", "Z", None, None, None, 2.0, 1)],
        "album_rowid BIGINT, album_name STRING, artist_rowid BIGINT, label_rowid INT, label STRING, artist_name STRING, album_type STRING, release_date STRING, release_date_precision STRING, logcount FLOAT, total_tracks INT",
    )
    labels = catalog.build_labels(label, geo("label_rowid", [(1, 1.5, 2.5)]))
    artists = catalog.build_artists(artist, geo("artist_rowid", [(10, 3.5, 4.5)]))
    return labels, artists, catalog.build_albums(album, geo("album_rowid", [(20, 5.5, 6.5), (21, 0.0, 0.0)]), artists, labels)


def test_denormalised_albums(spark):
    labels, artists, built = lookup_tables(spark)
    assert built.columns == list(catalog.ALBUM_COLUMNS)
    # a label without coordinates is dropped
    assert rows(labels, "label_rowid", "lon") == [(1, 1.5)]
    assert rows(built.where("album_rowid = 20"), "album_name_norm", "artist_lon", "label_lat", "album_canonical_rowid") == [("One", 3.5, 2.5, 20)]


def test_missing_parent_fails_validation(spark):
    _, _, built = lookup_tables(spark)
    with pytest.raises(ValueError, match="albums: required columns contain null/empty values: artist_lon=1, artist_lat=1, artist_logcount=1"):
        quality.require_columns(built, list(catalog.REQUIRED_ALBUM), "albums")
    quality.require_columns(built.where("album_rowid = 20"), list(catalog.REQUIRED_ALBUM), "albums")


def test_album_tracks(spark):
    tracks = spark.createDataFrame(
        [(1, 5, 2.0, True), (2, 5, 3.0, True), (3, 5, 3.0, True), (4, 5, 9.0, False), (5, 6, 1.0, True)],
        "track_rowid BIGINT, album_rowid BIGINT, logcount DOUBLE, searchable BOOLEAN",
    )
    assert rows(reprs.album_tracks(tracks, 2)) == [(5, 0, 2, 3.0), (5, 1, 3, 3.0), (6, 0, 5, 1.0)]


def test_artist_albums(spark):
    tracks = spark.createDataFrame(
        [(1, 3.0), (1, 1.0), (1, 2.0), (2, 5.0), (2, 4.0), (3, 1.0), (3, 1.0)], "album_rowid BIGINT, logcount DOUBLE"
    ).withColumn("searchable", F.lit(True))
    shelf = spark.createDataFrame(
        [(1, 10, 3.0, "album"), (2, 10, 2.0, "Album"), (3, 10, 1.0, "ep"), (4, 11, 1.0, "album")],
        "album_rowid BIGINT, artist_rowid BIGINT, logcount DOUBLE, album_type STRING",
    ).selectExpr("*", "album_rowid AS album_canonical_rowid", "true AS searchable")
    assert rows(reprs.artist_albums(tracks, shelf, 2)) == [(10, 0, 2, 4.5), (10, 1, 1, 2.0)]
    assert rows(reprs.artist_albums(tracks, shelf.withColumn("searchable", F.col("album_rowid") == 3), 2)) == [(10, 0, 3, 1.0)]


def test_label_artists(spark):
    tracks = spark.createDataFrame(
        [(1, 10, 4.0), (1, 10, 3.0), (1, 20, 2.0), (1, 20, 2.0), (1, 20, 2.0)], "label_rowid INT, artist_rowid BIGINT, logcount DOUBLE"
    )
    got = rows(reprs.rank_label_artists(tracks, 2))
    assert [r[:3] for r in got] == [(1, 0, 10), (1, 1, 20)]
    assert got[0][3] == pytest.approx(7 / 2**0.5) and got[1][3] == pytest.approx(6 / 3**0.5)
    flagged = tracks.withColumn("searchable", F.lit(True))
    visible = spark.createDataFrame([(10, False), (20, True)], "artist_rowid BIGINT, searchable BOOLEAN")
    assert [r[2] for r in rows(reprs.label_artists(flagged, visible, 2))] == [20]


def test_nrepr(spark):
    table = spark.createDataFrame([(1,), (2,)], "album_rowid BIGINT")
    links = spark.createDataFrame([(1, 0), (1, 1)], "album_rowid BIGINT, rank INT")
    assert rows(reprs.with_nrepr(table, links, ALBUM)) == [(1, 2), (2, 0)]


def test_ranking_of_a_hot_album_is_whole(spark):
    """A third of all tracks on one album: ranks are the true ones and every album is there."""
    tracks = spark.range(9000).select(
        F.col("id").alias("track_rowid"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("album_rowid"),
        (F.col("id") * 7919 % 1000 / 100).alias("logcount"), F.lit(True).alias("searchable"),
    )
    got = reprs.album_tracks(tracks, 3)
    data = sorted(((r.album_rowid, -r.logcount, r.track_rowid) for r in tracks.collect()))
    expected, seen = [], {}
    for album, score, track in data:
        n = seen[album] = seen.get(album, -1) + 1
        if n < 3:
            expected.append((album, n, track, -score))
    assert rows(got) == sorted(expected, key=repr)


def test_guarantee_failures_are_reported(spark):
    report = spark.createDataFrame(
        [("a", True, False, 0), ("b", False, True, 1), ("c", False, False, 2)], "check STRING, ok BOOLEAN, acceptable BOOLEAN, violations BIGINT"
    )
    with pytest.raises(ValueError, match="failed guarantees: c$"):
        quality.require_guarantees(report)
    quality.require_guarantees(report.where("check <> 'c'"))


def test_two_way_inclusion(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "k INT")
    right = spark.createDataFrame([(2,), (3,), (4,)], "k INT")
    assert rows(quality.two_way(left, right, "k")) == [(1, 2)]
    assert rows(quality.is_subset(left, right, "k")) == [(1,)]


def test_guarantee_report_counts_violations(spark):
    """Sound tables have none; each kind of fault is counted where it belongs."""
    def frame(data, spec):
        return spark.createDataFrame(data, spec)

    def made(labels=((1, 1, "L", True, 1),), extra=()):
        return {
            "tracks": frame([(1, 1, True, "t", "t", "al", "ar", "L", 1, 1, 1), *extra],
                            "track_rowid BIGINT, track_canonical_rowid BIGINT, searchable BOOLEAN, track_name STRING, track_name_norm STRING, "
                            "album_name STRING, artist_name STRING, label STRING, album_rowid BIGINT, artist_rowid BIGINT, label_rowid INT"),
            "albums": frame([(1, 1, True, "al", "al", "ar", "L", 1, 1, 1)],
                            "album_rowid BIGINT, album_canonical_rowid BIGINT, searchable BOOLEAN, album_name STRING, album_name_norm STRING, "
                            "artist_name STRING, label STRING, artist_rowid BIGINT, label_rowid INT, nrepr INT"),
            "artists": frame([(1, 1, True, "ar", 1)], "artist_rowid BIGINT, artist_canonical_rowid BIGINT, searchable BOOLEAN, artist_name STRING, nrepr INT"),
            "labels": frame(list(labels), "label_rowid INT, label_canonical_rowid INT, label STRING, searchable BOOLEAN, nrepr INT"),
            **{e.embedding: frame([(1, [1.0])], f"{e.key} BIGINT, embedding ARRAY<FLOAT>") for e in ENTITIES},
            "album_repr_tracks": frame([(1, 0, 1)], "album_rowid BIGINT, rank INT, track_rowid BIGINT"),
            "artist_repr_albums": frame([(1, 0, 1)], "artist_rowid BIGINT, rank INT, album_rowid BIGINT"),
            "label_repr_artists": frame([(1, 0, 1)], "label_rowid INT, rank INT, artist_rowid BIGINT"),
        }

    def faults(tables):
        return {r.check: r.violations for r in guarantees.guarantee_report(tables).where("not ok").collect()}

    assert faults(made()) == {}
    assert guarantees.guarantee_report(made()).count() == 50
    labels = ((1, 1, "L", True, 2), (2, 9, "L", True, 0), (3, 3, "", True, 0))
    assert faults(made(labels)) == {
        "labels.nrepr matches label_repr_artists": 1, "labels.label_canonical_rowid exists": 1, "labels.label is unique": 1,
        "no blanks in labels.label": 1, "labels.label_rowid in tracks.label_rowid": 2, "labels.label_rowid in albums.label_rowid": 2,
        "labels.label_rowid in label_embedding.label_rowid": 2}
    extra = [(1, 1, True, "", "t", "al", "ar", "L", 5, None, 1)]
    assert faults(made(extra=extra)) == {
        "tracks.track_rowid is unique": 1, "no blanks in tracks.track_name": 1, "tracks.album_rowid in albums.album_rowid": 1,
        "tracks.artist_rowid in artists.artist_rowid": 1}
    broken = made()
    for e in (ALBUM, ARTIST, LABEL):
        broken[e.repr_table] = broken[e.repr_table].unionAll(broken[e.repr_table])
    assert faults(broken) == {f"{e.repr_table} key is unique": 1 for e in (ALBUM, ARTIST, LABEL)} | {
        f"{e.table}.nrepr matches {e.repr_table}": 1 for e in (ALBUM, ARTIST, LABEL)}


def test_validate_is_a_gate(spark, tmp_path):
    from coocatlas.plans.build import Atlas, Settings
    from coocatlas.sources import binding
    from coocatlas.sources.staging import Staging

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables absent")
    settings = Settings(thresholds=Thresholds(1.2, 2, 2, 2, 1.3))
    atlas = Atlas(binding.bind(spark, folder), Staging(spark, "gate"), settings)
    atlas.validate()
    assert atlas.tables["label_embedding"].schema["embedding"].dataType.simpleString() == "array<float>"
    first = atlas.index("artist", nlist=2, trained=False)
    files = sorted(os.listdir(atlas.staging.path("index_artist_2_sampled").removeprefix("file:")))
    assert files == ["cells", "lists"] and (atlas.index("artist", nlist=2, trained=False).sizes == first.sizes).all()
    broken = Atlas(atlas.sources, Staging(spark, "gate"), settings)
    broken.tables = {**atlas.tables, "labels": atlas.tables["labels"].limit(0)}
    with pytest.raises(ValueError, match="failed guarantees: .*albums.label_rowid in labels.label_rowid"):
        broken.validate()
