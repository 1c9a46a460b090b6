import numpy as np
import pytest
from pyspark.sql import functions as F

from coocatlas.functions import numeric, text, vectors
from coocatlas.functions.hashing import uniform

# Titles and what they are normalised to.
TITLES = [
    ("Untitled", "Untitled"),
    ("Untitled (Remastered Edition)", "Untitled"),
    ("OK Computer (Deluxe)", "OK Computer"),
    ("In Rainbows (Disk 2)", "In Rainbows (Disk 2)"),
    ("  Spaced   (Expanded)  ", "Spaced"),
    ("...And Justice For All", "..And Justice For All"),
    ("....And Justice For All", "..And Justice For All"),
    ("Foo.....Bar", "Foo..Bar"),
    ("...Album [Deluxe]", "..Album"),
    ("..And Justice For All", "..And Justice For All"),
    ("[L] [DELUXE]", "[L]"),
    ("[What's the Story] Morning Glory? [Remastered]", "[What's the Story] Morning Glory?"),
    ("D-Sides [Special Edition]", "D-Sides"),
    ("The Post COVID-19 Mixtape - Chill Edition", "The Post COVID-19 Mixtape"),
    ("Rap-a-Lot 25th Anniversary", "Rap-a-Lot 25th Anniversary"),
    ("それは小さな光のような-special edition", "それは小さな光のような-special edition"),
    ("The Perfect Girl [(Instrumental) [Alternate Versions]]", "The Perfect Girl"),
]


def one(spark, values, expression, name="v", kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} {kind}")
    return [r["out"] for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_normalize_title(spark):
    assert one(spark, [t for t, _ in TITLES], text.normalize_title(F.col("v"))) == [n for _, n in TITLES]
    assert one(spark, [None, ""], text.normalize_title(F.col("v"))) == [None, ""]


def test_fold_key(spark):
    assert one(spark, ["Straße", " strasse ", "CAN", " can\t"], text.fold_key(F.col("v"))) == [
        "strasse", "strasse", "can", "can",
    ]


def test_human_count(spark):
    given = [0.0, 999.0, 1000.0, 1049.0, 617250.0, 617750.0, 864150.0, 7436313.0, 2e9, 1.26e9]
    assert one(spark, given, text.human_count(F.col("v")), kind="DOUBLE") == [
        "0", "999", "1K", "1K", "617.3K", "617.8K", "864.1K", "7.4M", "2B", "1.3B",
    ]


def test_playlist_count_text(spark):
    assert one(spark, [3.0, 0.0], text.playlist_count_text(F.col("v")), kind="DOUBLE") == ["1K playlists", "1 playlists"]


def test_display_track_name(spark):
    assert one(spark, ["a", "", None], text.display_track_name(F.col("v"))) == ["a"] + ["[no track name]"] * 2


def test_search_ids(spark):
    df = spark.createDataFrame([("track_12",), ("label_3",)], "v STRING")
    got = [tuple(r) for r in df.select("v", text.parse_search_id(F.col("v")).alias("e")).select("e.*").collect()]
    assert got == [("track", 12), ("label", 3)]
    assert one(spark, [5], text.search_id("album", F.col("v")), kind="BIGINT") == ["album_5"]
    with pytest.raises(Exception, match="invalid search id"):
        spark.createDataFrame([("invalid_123",)], "v STRING").select(text.parse_search_id(F.col("v"))).collect()


def test_list_sizes(spark):
    assert one(spark, [10, 1_000_000, 100_000_000], numeric.list_count(F.col("v")), kind="BIGINT") == [256, 4000, 16384]
    assert one(spark, [10, 1_000_000], numeric.train_size(F.col("v")), kind="BIGINT") == [10, 256_000]


def test_default_popfloor(spark):
    assert one(spark, [0.0, 2.4, 2.5, 4.49], numeric.default_popfloor(F.col("v")), kind="DOUBLE") == [0, 0, 1, 2]


def test_tms_flip(spark):
    flip = numeric.tms_flip(F.lit(3), F.col("v"))
    assert one(spark, [0, 7, 3], flip, kind="INT") == [7, 0, 4]


def test_scale_axis_rounds_and_mirrors(spark):
    low, high = F.lit(0.0), F.lit(3.0)
    assert one(spark, [0.0, 1.0, 3.0], numeric.scale_axis(F.col("v"), low, high, 10.0), kind="DOUBLE") == [
        np.float32(-10), np.float32(-3.333333), np.float32(10),
    ]
    assert one(spark, [0.0, 3.0], numeric.scale_axis(F.col("v"), low, high, -10.0), kind="DOUBLE") == [10.0, -10.0]


def test_l2_normalize_and_dot(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id INT, embedding ARRAY<FLOAT>")
    got = {r["id"]: r for r in vectors.l2_normalize(df).withColumn("d", vectors.dot(F.col("embedding"), F.col("embedding"))).collect()}
    assert np.allclose(got[1]["embedding"], [0.6, 0.8]) and got[1]["d"] == pytest.approx(1.0)
    assert got[2]["embedding"] == [0.0, 0.0]


def test_wide_round_trip_orders_by_number(spark):
    values = [float(i) for i in range(12)]
    df = spark.createDataFrame([(1, values)], "id INT, embedding ARRAY<FLOAT>")
    wide = vectors.to_wide(df, 12)
    assert vectors.wide_columns(wide.select(*reversed(wide.columns))) == [f"e{i}" for i in range(12)]
    assert vectors.from_wide(wide).first()["embedding"] == values
    with pytest.raises(ValueError):
        vectors.from_wide(df.select("id"))


@pytest.mark.parametrize("portable", [True, False])
def test_uniform_draws(spark, portable):
    df = spark.range(20_000)
    draw = uniform(7, "id", portable=portable)
    values = np.array([r[0] for r in df.select(draw).collect()])
    assert 0 <= values.min() and values.max() < 1
    assert np.abs(np.histogram(values, 10, (0, 1))[0] - 2000).max() < 250
    again = np.array([r[0] for r in df.repartition(13).orderBy("id").select(draw).collect()])
    assert (values == again).all()
    assert (values != np.array([r[0] for r in df.select(uniform(8, "id", portable=portable)).collect()])).mean() > 0.99
