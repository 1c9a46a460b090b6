import time

from coocatlas.sources import staging


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_staged_tables_drop_their_shuffles_side_by_side(spark, tmp_path):
    """The files of a build's shuffles went only when the driver collected garbage; the session's setting comes back."""
    before, setting = shuffle_files(spark), spark.conf.get(staging.CLEANUP, "false")
    stages = staging.Staging(spark, str(tmp_path), fresh=True)
    made = stages.together({f"t{i}": lambda i=i: spark.range(10_000 * (i + 1)).repartition(4) for i in range(3)})
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [made[f"t{i}"].count() for i in range(3)] == [10_000, 20_000, 30_000]
    assert spark.conf.get(staging.CLEANUP) == setting
