"""Tables in the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from mosaicq import workspace


def test_scratch_deletes_what_it_wrote(spark):
    with workspace.scratch(spark):
        df = workspace.materialise(spark.range(5), "scratch-test")
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    kept = workspace.materialise(spark.range(3), "scratch-test")
    assert kept.count() == 3
    workspace.discard(spark, kept)


def test_memoised_reads_what_exists(spark, tmp_path):
    path = f"file://{tmp_path}/memo"
    assert workspace.memoised(spark.range(4), path).count() == 4
    never = spark.range(4).select(F.raise_error(F.lit("computed again")).cast("long").alias("id"))
    assert workspace.memoised(never, path).count() == 4
    os.remove(tmp_path / "memo" / "_SUCCESS")
    with pytest.raises(Exception, match="computed again"):
        workspace.memoised(never, path).count()


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()
        conf = spark.conf

    before = workspace.shared_dir(spark)
    assert workspace.shared_dir(Session()) == before  # set by the tests' own session

    class Unset:
        def isDefined(self):
            return False

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return Unset()

    class Conf:
        def get(self, key, default=None):
            return default

    Context._jsc = Jsc()
    Session.conf = Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())


def test_arrow_rows_bound_batches_and_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    with workspace.arrow_rows(spark, 100):
        got = [r.n for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert got == [100] * 10 and spark.conf.get(key) == before
