"""Where intermediate tables go, and how they go away."""

import os
from types import SimpleNamespace

import pytest

from marginalia.operators import stored as module


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="app-1")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))


def test_folder_of_the_cluster():
    assert module._run_folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y/marginalia/app-1"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        module.new_path(session(master))


def test_tables_are_dropped_together(spark):
    table = module.stored(spark.range(5))
    assert table.count() == 5
    folder = module._run_folder(spark).removeprefix("file:")
    assert os.listdir(folder)
    module.drop_stored(spark)
    assert not os.path.exists(folder)
    assert module.stored(spark.range(3)).count() == 3
