import pytest

from bitextry import session


class Fake:
    """A session as far as the shared folder is concerned."""

    def __init__(self, setting, master):
        self.conf = self
        self.sparkContext = self
        self.setting, self.master, self.applicationId = setting, master, f"{setting}-{master}"

    def getCheckpointDir(self):
        return "hdfs://set/on/context" if self.master == "k8s" else None

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.setting or default


def test_shared_folder_is_the_cluster_s_own():
    assert session.shared_dir(Fake("hdfs://x/check/", "yarn")) == "hdfs://x/check"
    assert session.shared_dir(Fake(None, "k8s")) == "hdfs://set/on/context"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake(None, "yarn"))


def test_a_temporary_folder_only_in_local_mode():
    local = Fake(None, "local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    assert session.scratch_path(local, "a") != session.scratch_path(local, "a")


def test_checkpointed_freezes_row_ids(spark):
    from pyspark.sql import functions as F

    df = session.checkpointed(spark.range(100).repartition(7).withColumn("row", F.monotonically_increasing_id()))
    assert sorted(df.collect()) == sorted(df.repartition(3).collect())


def test_small_checks_its_size(spark):
    def hinted(rows):
        return "broadcast" in session.small(spark.range(1), rows, 10)._jdf.queryExecution().logical().toString()

    assert hinted(10) and not hinted(11)
