import time

import pytest
from pyspark.sql import functions as F

from skyraster import session
from skyraster.operators import groups
from skyraster.operators.groups import accumulate
from skyraster.operators.merge import load_ignore, load_replace
from skyraster.operators.pairs import motion_pairs
from skyraster.plans.fixtures import sky_tables
from skyraster.streaming import cycles
from skyraster.streaming.cycles import MEMBER_STATE, OBS_STATE, _state, ingest

FOLDER = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_cluster_without_checkpoint_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Cluster())


def test_materialize_reports_metrics(spark):
    stored, seen = session.materialize_counted(spark.range(10), "numbers", {"total": F.sum("id")})
    assert (seen["rows"], seen["total"], stored.count()) == (10, 45, 10)


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    found = session.materialize(spark.range(1000).repartition(8, "id"), "numbers")
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and found.count() == 1000
    assert spark.conf.get(session.CLEANUP_CONF, "false") == "false"


def test_cycles_in_tiles(spark, tmp_path, monkeypatch):
    """Pairs of a cycle are not listed, but where rows of a time come apart, and where they are few."""
    obs = sky_tables(spark, FOLDER).stored_obs.filter("cycle < 2")
    expected = rows_of(accumulate(motion_pairs(obs, obs, 12, 3)))
    monkeypatch.setattr(groups, "LISTED_PAIRS", -1)
    listed = []
    pairs = cycles.motion_pairs
    monkeypatch.setattr(cycles, "motion_pairs", lambda *a: (listed.append(1), pairs(*a))[1])
    path = str(tmp_path / "state")
    for number in range(2):
        ingest(obs.filter(F.col("cycle") == number), number, path, 12, 3)
    found = _state(spark, f"{path}/members", MEMBER_STATE, None)
    assert rows_of(found.select("obsgroupid", "obsid")) == expected and not listed
    ingest(obs.filter("cycle = 1").withColumn("obsid", F.col("obsid") + 10_000), 2, path, 12, 3)
    assert listed


def test_cycles_equal_one_shot_and_can_be_repeated(spark, tmp_path):
    obs = sky_tables(spark, FOLDER).stored_obs
    expected = rows_of(accumulate(motion_pairs(obs, obs, 12, 3)))
    assert expected
    path = str(tmp_path / "state")
    for number in range(6):
        part = obs.filter(F.col("cycle") == number)
        ingest(part, number, path, 12, 3)
        if number in (0, 3, 5):
            ingest(part, number, path, 12, 3)
    found = _state(spark, f"{path}/members", MEMBER_STATE, None)
    assert rows_of(found.select("obsgroupid", "obsid")) == expected
    assert rows_of(_state(spark, f"{path}/obs", OBS_STATE, None)) == rows_of(obs.select(*OBS_STATE.fieldNames()))


def test_duplicate_policies_rank_incoming_rows(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, line int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3)], "k int, v string, line int")
    assert rows_of(load_ignore(old, new, ["k"], ["line"])) == [(1, "a", 0), (2, "c", 2)]
    assert rows_of(load_replace(old, new, ["k"], ["line"])) == [(1, "b", 1), (2, "d", 3)]
