"""Checkpoint folder rules and staged tables."""

import pytest

from rolevec import session


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Ctx:
    def __init__(self, master, conf):
        self.master = master
        self._conf = _Conf(conf)
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, d):
        self.dir = d


class _RuntimeConf:
    def get(self, key):
        raise KeyError(key)


class _Spark:
    def __init__(self, master, conf):
        self.sparkContext = _Ctx(master, conf)
        self.conf = _RuntimeConf()


def test_reads_the_configured_folder():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert session.checkpoint_dir(s) == "hdfs:///shared/ckpt"


def test_refuses_a_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(_Spark("yarn", {}))


def test_local_session_gets_a_private_folder():
    d = session.checkpoint_dir(_Spark("local[2]", {}))
    assert "rolevec-ckpt-" in d


def test_scratch_paths_are_fresh():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    a, b = session.scratch_path(s, "x"), session.scratch_path(s, "x")
    assert a != b and a.startswith("hdfs:///shared/ckpt/rolevec-x-")


def test_staged_tables_end_with_their_block(spark):
    from pathlib import Path

    with session.staging(spark) as paths:
        t = session.stage_table(spark.range(5), "t")
        assert t.count() == 5 and len(paths) == 1
        folder = Path(paths[0].removeprefix("file:"))
        assert folder.exists()
    assert not folder.exists()
    assert session.stage_table(spark.range(3), "t").count() == 3  # outside a block it stays


def test_result_of_a_block_outlives_it(spark):
    """A block's working tables go with it; its result lives until the block around it ends."""
    import os

    from rolevec.session import stage_table, staging

    def folder(df):
        return df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]

    with staging(spark):
        with staging(spark):
            work = folder(stage_table(spark.range(3), "work"))
            result = folder(stage_table(spark.range(3), "result", outlive=True))
            assert os.path.isdir(work) and os.path.isdir(result)
        assert not os.path.isdir(work) and os.path.isdir(result)
    assert not os.path.isdir(result)
    with staging(spark):
        kept = folder(stage_table(spark.range(3), "kept", outlive=True))
    assert os.path.isdir(kept)
