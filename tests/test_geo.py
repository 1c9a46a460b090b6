import json
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas.operators import geo
from coocatlas.schema import ENTITIES

DEFAULT = {"track": [(0, 0), (1, 1)], "artist": [(0.5, 0.5)], "album": [(0.25, 0.75)], "label": [(0.75, 0.25)]}


def projections(spark, points=DEFAULT):
    return {
        e.name: spark.createDataFrame(
            [(i, float(x), float(y)) for i, (x, y) in enumerate(points[e.name])], f"{e.key} BIGINT, umap_x DOUBLE, umap_y DOUBLE"
        )
        for e in ENTITIES
    }


def placed(spark, points=DEFAULT, **kwargs):
    df = geo.to_lonlat(geo.union_projections(projections(spark, points)), **kwargs)
    assert dict(df.dtypes)["lon"] == "float"
    return {(r.entity, r.rowid): (r.lon, r.lat) for r in df.collect()}


def test_extremes_reach_the_edges_without_padding(spark):
    got = placed(spark, half_lon=10.0, half_lat=20.0, padding=0.0)
    assert got["track", 0] == (-10, -20) and got["track", 1] == (10, 20)
    assert got["artist", 0] == (0, 0) and got["album", 0] == (-5, 10)


def test_padding_and_mirror(spark):
    got = placed(spark, half_lon=-22.5, half_lat=22.5, padding=1.0)
    assert got["track", 0] == (7.5, -7.5) and got["track", 1] == (-7.5, 7.5)


def test_entities_share_one_box(spark):
    got = placed(spark, {**DEFAULT, "label": [(9, 0)]}, half_lon=9.0, padding=0.0)
    assert got["label", 0][0] == 9.0 and got["track", 1][0] == -7.0


def test_feature_lines(spark, tmp_path):
    table = spark.createDataFrame([(2, 1.5, -2.5, 3.25), (1, 0.0, 0.5, 1.0)], "track_rowid BIGINT, lon DOUBLE, lat DOUBLE, logcount DOUBLE")
    geo.write_geojson(geo.feature_json(table, "track"), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines, key=lambda f: f["properties"]["track_rowid"])[1] == {
        "type": "Feature",
        "geometry": {"type": "Point", "coordinates": [1.5, -2.5]},
        "properties": {"track_rowid": 2, "logcount": 3.25},
    }


def test_density_bins_match_numpy(spark):
    xy = np.random.default_rng(0).normal(size=(500, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "track_rowid INT, umap_x DOUBLE, umap_y DOUBLE")
    low, high = xy.min(0), xy.max(0)
    cells = np.clip(((xy - low) / (high - low) * 20).astype(int), 0, 19)
    expected = {}
    for x, y in cells.tolist():
        expected[x, y] = expected.get((x, y), 0) + 1
    assert {(r.xi, r.yi): r.n for r in geo.density_bins(df, 20).collect()} == expected
    s = {r.axis: r for r in geo.coordinate_summary(df).collect()}
    assert s["x"]["std"] == pytest.approx(xy[:, 0].std()) and s["y"].center == pytest.approx((low[1] + high[1]) / 2)


def test_highlights_take_the_most_popular_and_keep_misses(spark):
    points = spark.createDataFrame(
        [(1, "Can", "Vitamin C", 2.0, 0.1, 0.2), (2, "CAN", "vitamin c", 3.0, 0.3, 0.4), (3, "Can", "Spoon", None, 0.0, 0.0)],
        "track_rowid BIGINT, artist_name STRING, track_name STRING, logcount DOUBLE, umap_x DOUBLE, umap_y DOUBLE",
    )
    wanted = spark.createDataFrame([("can", "VITAMIN C"), ("can", "nothing")], "artist STRING, track STRING")
    assert rows(geo.highlights(points, wanted), "track", "found", "track_rowid") == [("VITAMIN C", True, 2), ("nothing", False, None)]


def placed_points(spark, n=3000):
    rng = np.random.default_rng(2)
    data = [(ENTITIES[i % 4].name, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(
        np.c_[rng.uniform(-22, 22, (n, 2)), rng.uniform(0, 5, n)])]
    return spark.createDataFrame(data, "entity STRING, rowid BIGINT, lon DOUBLE, lat DOUBLE, logcount DOUBLE")


ZOOMS = {"track": 9, "album": 8, "artist": 7, "label": 6}


def test_tiles_nest_and_thin_out(spark):
    tiles = geo.tile_points(placed_points(spark), ZOOMS, 9).collect()
    shown = {}
    for t in tiles:
        shown.setdefault(t.z, {})[t.layer, t.rowid] = (t.x, t.y)
    assert len(shown[9]) == 3000
    for z in range(5, 9):
        assert shown[z].keys() <= shown[z + 1].keys()
        assert all((x, y) == (shown[z + 1][k][0] // 2, shown[z + 1][k][1] // 2) for k, (x, y) in shown[z].items())
    assert len([k for k in shown[8] if k[0] == "track"]) == pytest.approx(750 / 1.8, rel=0.15)


def test_tile_size_stats(spark):
    archive = spark.createDataFrame(
        [(5, 1, 2, 10), (6, 3, 60, 30), (6, 3, 4, 30), (6, 2, 63, 30)], "zoom_level INT, tile_column INT, tile_row INT, size BIGINT"
    )
    assert rows(geo.tile_size_stats(archive)) == [(4, 100, 25.0, 30, 6, 3, 3)]
    assert rows(geo.tile_size_stats(archive.where("size > 99")), "tiles", "total_size", "mean_size", "max_size") == [(0, 0, 0.0, 0)]


def test_picking_matches_brute_force_with_a_dense_spot(spark):
    spread = placed_points(spark, 2000)
    dense = spread.withColumn("rowid", F.col("rowid") + 5000).withColumns({"lon": F.lit(1.0) + F.col("rowid") * 1e-6, "lat": F.lit(1.0)})
    features = spread.unionByName(dense.limit(1000))
    clicks = spread.where("rowid % 40 = 0").select(F.col("rowid").alias("click_id"), "lon", "lat").union(
        spark.createDataFrame([(-1, 1.0, 1.0), (-2, 100.0, 60.0)], "a BIGINT, b DOUBLE, c DOUBLE")
    )
    got = {r.click_id: (r.entity, r.rowid) for r in geo.pick_features(clicks, features, 6, 10.0).collect()}
    size = 512 * 2**6

    def px(lon, lat):
        s = math.sin(math.radians(lat))
        return (lon + 180) / 360 * size, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * size

    pts = [(r.entity, r.rowid, r.logcount, *px(r.lon, r.lat)) for r in features.collect()]
    expected = {}
    for c in clicks.collect():
        x, y = px(c.lon, c.lat)
        near = [(-p[2], p[0], p[1]) for p in pts if (p[3] - x) ** 2 + (p[4] - y) ** 2 <= 100]
        if near:
            expected[c.click_id] = min(near)[1:]
    assert got == expected and -1 in got and -2 not in got


def test_radius_of_its_own_and_equal_places(spark):
    """A very popular feature is hit from afar; of many at one place the first is picked."""
    data = [("track", i, 0.0, 0.0, 1.0 + i % 7) for i in range(500)] + [("artist", 1, 1.0, 0.0, 40.0), ("label", 2, 0.0, 0.5, 3.0)]
    features = spark.createDataFrame(data, "entity STRING, rowid BIGINT, lon DOUBLE, lat DOUBLE, logcount DOUBLE")
    scale = 360 / (512 * 2**6)
    clicks = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, 1.0 + 39 * scale, 0.0), (3, 1.0 + 41 * scale, 0.0), (4, 10 * scale, 0.0), (5, 12 * scale, 0.0)],
        "click_id INT, lon DOUBLE, lat DOUBLE")
    got = {r.click_id: (r.entity, r.rowid) for r in geo.pick_features(clicks, features, 6, 11.0).collect()}
    assert got == {1: ("track", 6), 2: ("artist", 1), 4: ("track", 6)}
    tiles = spark.createDataFrame([("track", 6, 13, 0, 0), ("artist", 5, 1, 0, 0)], "layer STRING, z INT, rowid BIGINT, x INT, y INT")
    assert rows(geo.shown_at(features, tiles, 6), "entity", "rowid") == [("track", 13)]


def test_axes_are_fitted_on_all_tracks(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(400, 5)) * [1, 6, 1, 3, 1] + 7
    frame = lambda key, a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"{key} BIGINT, embedding ARRAY<DOUBLE>")
    got = geo.project_2d({e.name: frame(e.key, m if e.name == "track" else m[:9]) for e in ENTITIES})
    xy = np.array([(r.umap_x, r.umap_y) for r in got["track"].orderBy("track_rowid").collect()])
    axes = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(xy), np.abs((m - m.mean(axis=0)) @ axes.T), atol=1e-4)


def test_projection_uses_one_model_for_all(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 6)) * [5, 3, 1, 1, 1, 1]
    frame = lambda key, a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"{key} BIGINT, embedding ARRAY<FLOAT>")
    vectors = {e.name: frame(e.key, m) for e in ENTITIES}
    popularity = spark.createDataFrame([(i, float(i)) for i in range(60)], "track_rowid BIGINT, logcount DOUBLE")
    for dims in (None, 4):
        got = geo.project_2d(vectors, popularity, sample=30, dims=dims)
        tables = {n: [r[1:] for r in rows(df)] for n, df in got.items()}
        assert len(tables["track"]) == 60 and np.isfinite(np.array(tables["track"])).all()
        assert all(t == tables["track"] for t in tables.values())


def test_picking_makes_no_pair_of_every_click_and_every_feature_around(spark):
    """In a dense spot only the features that can be picked meet the clicks: four times both, about four times the pairs."""
    scale = 360 / (512 * 2**6)

    def pairs(n):
        draw = np.random.default_rng(n)
        at = [(float(x * scale), float(y * scale)) for x, y in draw.uniform(0, 40, (n, 2))]
        features = spark.createDataFrame(
            [("track", i, lon, lat, float(draw.integers(1, 9))) for i, (lon, lat) in enumerate(at)],
            "entity STRING, rowid BIGINT, lon DOUBLE, lat DOUBLE, logcount DOUBLE")
        clicks = features.where("rowid % 4 = 0").select(F.col("rowid").alias("click_id"), "lon", "lat")
        asked, rivals = geo.pick_sides(clicks, features, 6, 10.0)
        return asked.join(rivals, geo.PICK_CELL).count() / clicks.count()

    few, many = pairs(1000), pairs(4000)
    assert many < 60 and many < 2 * few
