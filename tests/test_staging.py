"""Where intermediate tables may stand."""

import pytest

from conftest import rows_of
from wakeline.sources import staging


def test_tables_are_written_together(spark):
    got = staging.stage_together(one=spark.range(3), two=spark.sql("SELECT 'x' AS a"))
    assert rows_of(got[0]) == [(0,), (1,), (2,)] and rows_of(got[1]) == [("x",)]
    assert [df.inputFiles()[0].split("/")[-2].split("-")[0] for df in got] == ["one", "two"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/warehouse"}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())
    for master in ("local", "local[8]"):
        Context.master = master
        assert staging.staging_root(Session()) == "file:/warehouse/_staged"
