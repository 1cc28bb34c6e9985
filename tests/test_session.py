"""The shared folder, on masters that the tests do not have."""

from types import SimpleNamespace

import pytest

from tallygrid import new_run_dir, shared_dir


def _session(spark, configured="", set_dir=None, master="spark://somewhere:7077"):
    context = SimpleNamespace(master=master, applicationId="made-up", getCheckpointDir=lambda: set_dir)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: configured), _jvm=spark._jvm, _jsc=spark._jsc)


@pytest.mark.parametrize("configured", ["/mnt/share/", "file:///mnt/share", "hdfs://store/share"])
def test_cluster_takes_the_folder_as_named(spark, configured):
    assert shared_dir(_session(spark, configured)) == configured.rstrip("/")
    assert new_run_dir(_session(spark, configured), "events").startswith(f"{configured.rstrip('/')}/events-")


def test_cluster_takes_the_context_checkpoint_folder(spark):
    assert shared_dir(_session(spark, set_dir="file:/mnt/share/1")) == "file:/mnt/share/1"
    assert shared_dir(_session(spark, "/mnt/named", set_dir="file:/mnt/share/1")) == "/mnt/named"


def test_cluster_without_a_folder_is_refused(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_session(spark))
