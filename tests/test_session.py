from types import SimpleNamespace

import pytest

from leadloom.session import scratch_path, shared_folder


def fake(folder=None, current=None, master="yarn"):
    context = SimpleNamespace(getCheckpointDir=lambda: current, master=master, setCheckpointDir=lambda f: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d),
                           sparkContext=context)


def test_the_cluster_names_the_folder():
    assert shared_folder(fake("hdfs:///shared/", "file:/else")) == "hdfs:///shared"
    assert shared_folder(fake(None, "s3a://bucket/dir")) == "s3a://bucket/dir"
    with pytest.raises(RuntimeError):
        shared_folder(fake())
    assert "leadloom-" in shared_folder(fake(master="local[2]"))
    assert scratch_path(fake("/x"), "a") != scratch_path(fake("/x"), "a")
