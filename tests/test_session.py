import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortlens import session

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_settings_are_put_back(spark):
    before = spark.conf.get(KEY, None)
    with pytest.raises(RuntimeError), session.setting(spark, KEY, "true"):
        assert spark.conf.get(KEY) == "true"
        raise RuntimeError
    assert spark.conf.get(KEY, None) == before
    with session.setting(spark, "cohortlens.unset", "1"):
        pass
    assert spark.conf.get("cohortlens.unset", None) is None


def test_a_cut_result_outlives_its_shuffles(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    done = session.cut(df)
    assert done.groupBy().sum("count").first()[0] == 1000 and done.count() == 7
    assert session.passing(df).count() == 7 and df.count() == 7


def test_a_cluster_must_name_its_folder():
    def fake(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda f: None, master=master))

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs://shared")) == "hdfs://shared"
    assert all(session.shared_dir(fake(m)).startswith("file://") for m in ("local", "local[4]", "local[*]"))


def test_folders_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    session.remove(spark, f"file://{tmp_path}/x")
    assert not os.path.exists(tmp_path / "x")
