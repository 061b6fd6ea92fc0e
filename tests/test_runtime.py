import pytest

from seogo import runtime


class Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder

class Session:
    def __init__(self, folder, master):
        self.conf = Conf(folder)
        self.sparkContext = type("C", (), {"master": master, "applicationId": "x"})



def test_written_tables_survive_their_source_and_can_be_forgotten(spark):
    df = runtime.written(spark.range(5).selectExpr("id", "cast(null as string) as n"), "t")
    assert df.count() == 5 and df.dtypes == [("id", "bigint"), ("n", "string")] and "seogo-t-" in df.inputFiles()[0]
    assert runtime.forget_written(spark) >= 1 and runtime.forget_written(spark) == 0


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    own = runtime.shared_folder(spark)
    assert own == (spark.conf.get("spark.checkpoint.dir", None) or own) and runtime.shared_folder(spark) == own
    unset = runtime.shared_folder(Session(None, "local[2]"))
    assert unset.startswith("file://") and runtime.shared_folder(Session(None, "local[2]")) == unset

    assert runtime.shared_folder(Session("hdfs://a/b/", "yarn")) == "hdfs://a/b"
    with pytest.raises(ValueError):
        runtime.shared_folder(Session(None, "yarn"))


def test_spread_leaves_large_tables_alone(spark):
    small, large = spark.range(10).coalesce(1), spark.range(100).repartition(9)
    assert runtime.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert runtime.spread(large).rdd.getNumPartitions() == 9


def test_kept_tables_last_as_long_as_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    made = []

    def table():
        df = spark.read.parquet(path)
        return runtime.kept(df, "test", lambda: made.append(1) or df.selectExpr("id * 2 as x"))

    assert sorted(r.x for r in table().collect()) == [0, 2, 4]
    runtime.forget_written(spark)
    assert table().count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert table().count() == 8 and len(made) == 2
