import random
from datetime import datetime, timedelta

import pytest

from alertloom.operators.thresholds import detection_filter
from alertloom.streaming.stateful import PROVIDER, StateThreshold

SCHEMA = "packet_id long, ts timestamp, sid int, src_ip string"


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


def finish(q):
    q.awaitTermination()
    assert q.exception() is None
    return q


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, tmp_path, batches, count=3, seconds=60, **options):
    """Each batch is a start of its own, from the checkpoint of the one before; the last row only moves time."""
    folder, late = str(tmp_path / "in"), 0
    threshold = StateThreshold(str(tmp_path / "out"), "src_ip", count, seconds, **options)
    for batch in [*batches, [(None, 10**6, None, None)]]:
        spark.createDataFrame([(i, None if t is None else at(t), s, a) for i, t, s, a in batch], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        q = finish(threshold.start(spark.readStream.schema(SCHEMA).parquet(folder), str(tmp_path / "progress")))
        left = sum(op.numRowsTotal for op in q.lastProgress.stateOperators)
        late += sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    assert left == 0  # spans that are over leave nothing behind
    return threshold, spark.read.schema(SCHEMA).parquet(folder), late


def ids(df):
    return sorted(r["packet_id"] for r in df.collect())


def test_restarts_equal_the_batch_operator(spark, tmp_path):
    """Random rows over restarts, with floods at one instant, null sources and spans without rows between."""
    rng, rows, batches = random.Random(5), [], []
    for low, high in ((0, 150), (150, 151), (151, 700), (2000, 2100)):
        part = [(len(rows) + k, rng.uniform(low + 0.001, high), rng.choice([1, 2]), rng.choice(["a", "b", "c", None])) for k in range(40)]
        part += [(len(rows) + 40 + k, high, 1, "a") for k in range(30)]
        rows += part
        batches.append(part)
    before = spark.conf.get(PROVIDER, None)
    threshold, stored, late = run(spark, tmp_path, batches, count=4)
    want = detection_filter(stored.where("sid is not null"), "src_ip", 4, 60)
    assert late == 0 and 0 < want.count() < len(rows)
    assert ids(threshold.passed(stored)) == ids(want)
    assert spark.conf.get(PROVIDER, None) == before


def test_late_rows_and_rows_without_time(spark, tmp_path):
    """Within the delay order does not matter; beyond it rows are dropped and counted."""
    batches = [[(1, 0, 1, "a"), (2, 50, 1, "a")], [(3, 20, 1, "a"), (4, 70, 1, "a"), (9, None, 1, "a")], [(5, 300, 1, "a")], [(6, 10, 1, "a"), (7, 500, 1, "a")]]
    threshold, stored, late = run(spark, tmp_path, batches, delay_seconds=60)
    assert ids(threshold.passed(stored)) == [2, 4] and late == 1


def test_many_sources_are_judged_together(spark, tmp_path):
    """Thousands of sources with spans of their own, judged many at a time: no key of the state costs a call of its own."""
    rng = random.Random(9)
    part = [(k, rng.uniform(0.001, 3000), rng.choice([1, 2]), f"s{k % 1500}") for k in range(12_000)]
    threshold, stored, late = run(spark, tmp_path, [part], count=2, seconds=600)
    want = detection_filter(stored.where("sid is not null"), "src_ip", 2, 600)
    assert late == 0 and 0 < want.count() < len(part)
    assert ids(threshold.passed(stored)) == ids(want)
    plan = threshold.verdicts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan
