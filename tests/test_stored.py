"""What a written intermediate table leaves on disk."""

from pathlib import Path

from switchboard.operators.skew import CLEANUP_CONF, stored


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = [Path(str(folder)) for folder in manager.localDirs()]
    return {path for root in roots for path in root.rglob("shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    rows = spark.range(10_000).selectExpr("id % 7 as key", "id").groupBy("key").count()
    before = shuffle_files(spark)
    found = stored(rows, "stored")
    assert not shuffle_files(spark) - before
    assert found.count() == 7 and rows.count() == 7  # the rows themselves can be asked again
    assert spark.conf.get(CLEANUP_CONF, None) is None


def test_a_setting_of_the_session_is_kept(spark):
    spark.conf.set(CLEANUP_CONF, "false")
    try:
        stored(spark.range(3).toDF("id"), "stored")
        assert spark.conf.get(CLEANUP_CONF) == "false"
    finally:
        spark.conf.unset(CLEANUP_CONF)
