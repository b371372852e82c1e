"""Session helpers: settings of a running session survive, lineage cuts do not nest folders."""

from daygrain.session import checkpoint_dir, get_session, materialize, scratch_path


def test_preset_conf_survives(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert get_session().conf.get("spark.sql.session.timeZone") == "Europe/Paris"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_checkpoint_folder_is_registered_once(spark):
    root, ctx = checkpoint_dir(spark), spark.sparkContext.getCheckpointDir()
    for _ in range(300):
        assert checkpoint_dir(spark) == root
        assert scratch_path(spark, "x").startswith(root + "/x/")
    assert spark.sparkContext.getCheckpointDir() == ctx


def test_materialize_many_times(spark):
    df = spark.range(3)
    for i in range(125):
        df = materialize(df, as_table=i % 20 == 0)
    assert df.count() == 3
