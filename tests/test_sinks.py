import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from coocatlas import schema
from coocatlas.operators import vocab
from coocatlas.sources import exports, sinks
from coocatlas.sources.staging import Staging, shared_dir


def test_typed_round_trip(spark, tmp_path):
    path = str(tmp_path / "vocab")
    df = spark.createDataFrame([(1, 5, 10)], "track_id BIGINT, playlist_count BIGINT, track_rowid INT")
    sinks.write_typed(df, schema.VOCAB, path)
    assert spark.read.parquet(path).schema.simpleString() == schema.VOCAB.simpleString()
    assert rows(sinks.read_typed(spark, path, schema.VOCAB, ["playlist_count"])) == [(5,)]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_typed(df, schema.VOCAB, path)
    with pytest.raises(ValueError, match="missing columns: playlist_count"):
        sinks.write_typed(df.drop("playlist_count"), schema.VOCAB, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_json_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("label_1", "Columbia", None)], "id STRING, label STRING, artist_name STRING")
    sinks.write_json(docs, str(tmp_path / "docs"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "docs")).collect()]
    assert json.loads(line) == {"id": "label_1", "label": "Columbia"}
    playlists = spark.range(10).select(F.col("id").alias("playlist_rowid"))
    sinks.write_manifest(vocab.chunk_manifest(playlists, 4), str(tmp_path / "manifest"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "manifest")).collect()]
    assert json.loads(line)["total_chunks"] == 3 and "created_at" in json.loads(line)


def test_staging_writes_once(spark):
    staging, built = Staging(spark, "test", fresh=True), []

    def build():
        built.append(1)
        return spark.range(3)

    assert rows(staging.table("t", build)) == rows(staging.table("t", build)) == [(0,), (1,), (2,)]
    assert built == [1]
    both = staging.together({"a": lambda: spark.range(1), "b": lambda: spark.range(2)})
    assert both["a"].count() == 1 and both["b"].count() == 2
    assert staging.root.startswith(shared_dir(spark))


def test_committed_exports(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception):
        exports.read_export(spark, path)
    df = spark.range(100).select(F.col("id").cast("int").alias("track_rowid"), F.lit(3).alias("track_id"), F.col("id").alias("playlist_count")).repartition(4)
    commit = exports.write_export(df, path, schema.VOCAB).first()
    assert (commit.rows, commit.files, commit.columns, commit.kind) == (100, 4, schema.VOCAB.fieldNames(), "parquet")
    back = exports.read_export(spark, path)
    assert back.schema.simpleString() == schema.VOCAB.simpleString() and rows(back, "track_rowid") == sorted(((i,) for i in range(100)), key=repr)
    # an attempt that wrote data but never committed changes nothing, a second commit replaces the first
    spark.range(7).write.parquet(f"{path}/data-lost")
    assert exports.read_export(spark, path).count() == 100
    exports.write_export(df.limit(5), path, schema.VOCAB)
    assert exports.read_export(spark, path).count() == 5
    with pytest.raises(ValueError, match="missing columns"):
        exports.write_export(df.drop("track_id"), path, schema.VOCAB)
    assert exports.read_export(spark, path).count() == 5


def test_changed_exports_are_refused(spark, tmp_path):
    path = str(tmp_path / "out")
    folder = exports.write_export(spark.range(10).repartition(2), path).first().folder
    spark.range(3).write.mode("append").parquet(f"{path}/{folder}")
    with pytest.raises(ValueError, match="differs from its file list"):
        exports.read_export(spark, path)
    assert exports.read_export(spark, path, verify=False).count() == 13


def test_export_kinds_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.1), (2, "é", None)], "a INT, b STRING, c DOUBLE")
    exports.write_export(df, str(tmp_path / "json"), kind="json")
    assert rows(exports.read_export(spark, str(tmp_path / "json"))) == rows(df)
    exports.write_export(df, str(tmp_path / "parts"), partition_by=("a",))
    assert rows(exports.read_export(spark, str(tmp_path / "parts")), "a", "b", "c") == rows(df)
    exports.write_export(df.select("b").where("b is not null"), str(tmp_path / "text"), kind="text")
    assert rows(exports.read_export(spark, str(tmp_path / "text"))) == [("é",)]
    commit = exports.write_export(df.limit(0), str(tmp_path / "none")).first()
    assert commit.rows == 0 and exports.read_export(spark, str(tmp_path / "none")).count() == 0
