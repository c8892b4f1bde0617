"""Finding F29: paths of a readiness gate share states, and ranges of a replayed table are written by several tasks."""

import pytest
from pyspark.sql import functions as F

from lamella.streaming import sources, state
from tests.test_readiness import outcomes


@pytest.mark.parametrize("buckets", [1, 5])
def test_paths_of_one_state_do_not_touch_each_other(spark, monkeypatch, buckets):
    monkeypatch.setattr(state, "BUCKETS", buckets)
    rows = [(f"whole{k}", s, k, True, k) for k in range(20) for s in (1, 2, 3)] + [(f"silent{k}", 1 + k % 7, 9, False, 9) for k in range(20)]
    rows += [(f"gone{k}", s, n, False, n) for k in range(20) for s, n in ((3, 9), (4, -1))] + [("clock", s, 0, False, 0) for s in (150, 151, 152)]
    want = [(f"whole{k}", 2, "READY", k) for k in range(20)] + [(f"silent{k}", 61 + k % 7, "TIMEOUT", 9) for k in range(20)] + [(f"gone{k}", 4, "GONE", 9) for k in range(20)]
    assert outcomes(spark, rows, 3) == sorted(want)


def test_ranges_are_batches_of_several_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sources, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(sources, "shared_folder", lambda spark: f"{tmp_path}/rows")
    stream = sources.replayed(spark.range(1000).select(F.col("id").alias("n")), "n", 2)
    batches = []
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, k: batches.append(sorted(r.n for r in b.collect()))).start()
    query.awaitTermination()
    assert len(list((tmp_path / "rows").glob("*.parquet"))) == 12
    assert len(batches) == 2 and batches[0] + batches[1] == list(range(1000))
