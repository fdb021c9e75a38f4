"""The pair stream keeps a row of state for a cell and time, not for each observation, and finds the same pairs."""

import random

from skyraster.operators.pairs import motion_pairs
from skyraster.streaming.pairs import motion_pair_stream

SCHEMA = "obsid long, time int, centerx int, centery int"


def test_stream_packs_observations_of_a_cell(spark, tmp_path):
    rng = random.Random(4)
    # More of one time than a pack holds, in a cell and over its border.
    rows = [(i, 1, rng.randrange(-60, 60), rng.randrange(-60, 60)) for i in range(1500)]
    rows += [(2000 + i, 2 + i % 4, rng.randrange(-60, 60), rng.randrange(-60, 60)) for i in range(400)]
    rows += [rows[3], rows[1600], (None, 2, 0, 0), (5000, None, 1, 1), (5001, 2, None, 1), (5002, 3, 1, None)]
    obs = spark.createDataFrame(rows, SCHEMA)
    obs.repartition(3).write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "obs"))
    again = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "obs"))
    query = (
        motion_pair_stream(stream, again, 2.5, 3)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "pairs"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "pairs"))
    expected = motion_pairs(obs, obs, 2.5, 3)
    assert expected.count() > 1000
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    kept = [op.numRowsTotal for step in query.recentProgress for op in step.stateOperators]
    assert kept and 4 * max(kept) < len(rows)
