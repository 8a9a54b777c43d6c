"""The shared folder."""

from types import SimpleNamespace

import pytest

from lumenfold.llm.common import work_dir


def session(master, path=None):
    missing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": path}, setCheckpointDir=lambda p: None, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: missing)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: path), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        work_dir(session(master))
    assert work_dir(session(master, "hdfs:///shared/")) == "hdfs:///shared"


def test_threads_of_the_driver_share_its_disk():
    assert work_dir(session("local[4]")).startswith("file:///") and work_dir(session("local")).startswith("file:///")


def test_a_sample_is_those_of_smallest_hash(spark):
    from pyspark.sql import functions as F

    from lumenfold.llm.common import hashed_sample

    rows = spark.range(5000)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 62))
    want = [r["id"] for r in rows.orderBy(h).limit(300).collect()]
    assert [r["id"] for r in hashed_sample(rows, "id", 300).collect()] == want
    assert hashed_sample(rows, "id", 6000).count() == 5000
