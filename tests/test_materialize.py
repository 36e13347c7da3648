from types import SimpleNamespace

import pytest

from logweave.plans.materialize import drop, fresh_folder, materialize, release, remove, shared_dir, store


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(master))
    shared_dir(session(master, "hdfs:///shared"))


def test_stored_tables_go_when_dropped(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "named_struct('a', id, 'b', cast(id as string)) AS s", "array(id) AS l")
    table = store(df)
    assert sorted(table.collect()) == sorted(df.collect()) == sorted(materialize(df).collect())
    path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    drop(table)
    release(spark)
    assert not fs.exists(path) and store(df.limit(0)).collect() == []
    folder = fresh_folder(spark, "x")
    remove(folder)  # nothing was written there
