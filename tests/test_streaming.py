from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.functions.parsing import FIELDS
from alertloom.operators.alerts import parse_alerts
from alertloom.operators.thresholds import detection_filter
from alertloom.streaming import jobs
from checks import inputs


def finish(q):
    q.awaitTermination()
    assert q.exception() is None


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


SCHEMA = "packet_id long, ts timestamp, sid int, src_ip string"


def stream_in_batches(spark, tmp_path, batches, **options):
    folder = tmp_path / "in"
    threshold = jobs.ThresholdStream(str(tmp_path / "state"), "src_ip", 3, 60, **options)
    for k, batch in enumerate(batches):
        spark.createDataFrame([(i, at(t), 1, s) for i, t, s in batch], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        finish(threshold.start(spark.readStream.schema(SCHEMA).parquet(str(folder)), str(tmp_path / "progress")))
    return threshold


def test_threshold_over_batches(spark, tmp_path):
    """State carries over batches and restarts; each start resumes from the checkpoint."""
    batches = [[(1, 0, "a"), (2, 0, "b")], [(3, 30, "a"), (4, 59, "a")], [(5, 61, "a"), (6, 100, "b")], [(7, 160, "a"), (8, 119, "b")]]
    threshold = stream_in_batches(spark, tmp_path, batches)
    rows = [(i, at(t), 1, s) for batch in batches for i, t, s in batch if i != 8]
    want = detection_filter(spark.createDataFrame(rows, SCHEMA), "src_ip", 3, 60)
    ids = lambda df: sorted(r["packet_id"] for r in df.collect())
    assert ids(threshold.passed(spark)) == ids(want) == [4, 5]


def test_late_rows_wait_for_the_watermark(spark, tmp_path):
    """Within the delay order does not matter; beyond it rows are dropped and counted."""
    batches = [[(1, 0, "a"), (2, 50, "a")], [(3, 20, "a"), (4, 70, "a")], [(5, 300, "a")], [(6, 10, "a"), (7, 500, "a")]]
    threshold = stream_in_batches(spark, tmp_path, batches, delay_seconds=60)
    # Row 2 passes only because row 3 arrived before the watermark reached it.
    assert sorted(r["packet_id"] for r in threshold.passed(spark).collect()) == [2, 4]
    assert threshold.late_rows(spark) == 1


def test_one_instant_in_two_batches(spark, tmp_path):
    """With a delay the parts of an instant are judged together; the flush judges what still waits."""
    batches = [[(1, 0, "a"), (2, 10, "a")], [(3, 10, "a"), (4, 31, "a")], [(5, 31, "a")]]
    threshold = stream_in_batches(spark, tmp_path, batches, delay_seconds=1)
    threshold.flush(spark)
    rows = [(i, at(t), 1, s) for batch in batches for i, t, s in batch]
    want = detection_filter(spark.createDataFrame(rows, SCHEMA), "src_ip", 3, 60)
    assert sorted(r["packet_id"] for r in threshold.passed(spark).collect()) == sorted(r["packet_id"] for r in want.collect()) == [2, 3, 4, 5]
    assert threshold.late_rows(spark) == 0


def test_instant_of_the_watermark_is_late(spark, tmp_path):
    threshold = stream_in_batches(spark, tmp_path, [[(1, 0, "a"), (2, 10, "a")], [(3, 10, "a")]])
    assert threshold.passed(spark).count() == 0 and threshold.late_rows(spark) == 1


def test_replayed_batch_changes_nothing(spark, tmp_path):
    threshold = stream_in_batches(spark, tmp_path, [[(1, 0, "a"), (2, 1, "a")], [(3, 2, "a")]])
    again = spark.createDataFrame([(3, at(2), 1, "a")], SCHEMA)
    threshold.judge(again, 1)
    assert [r["packet_id"] for r in threshold.passed(spark).collect()] == [3]


def test_alert_stream_equals_batch(spark, sf, tmp_path):
    lines = inputs.alert_lines(spark, sf).select("value")
    lines.repartition(5).write.text(str(tmp_path / "in"))
    finish(jobs.run_available(jobs.stream_alerts(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "progress")))
    rows = lambda df: sorted(map(tuple, df.select(*FIELDS).collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(parse_alerts(lines))


def test_logs_are_counted_in_the_same_pass(spark, sf, tmp_path):
    """Each batch of a stream names its lines, alerts and rejects without a second pass."""
    lines = inputs.alert_lines(spark, sf).select("value")
    lines.repartition(3).write.text(str(tmp_path / "in"))
    n = parse_alerts(lines).count()
    q = jobs.run_available(jobs.stream_alerts(spark, str(tmp_path / "in"), 1, "logs"), str(tmp_path / "out"), str(tmp_path / "progress"))
    finish(q)
    batches = [p["observedMetrics"]["logs"] for p in q.recentProgress if p["numInputRows"]]
    assert len(batches) == 3 and sum(b["alerts"] for b in batches) == n
    assert sum(b["lines"] for b in batches) == lines.count() == n + sum(b["rejects"] for b in batches) > n


def test_scoring_stream_equals_batch(spark, sf, tmp_path):
    from alertloom.models.detector import score_packets
    from alertloom.models.training import train_detector
    from alertloom.sources.packets import read_packets, stream_packets
    from checks.model_queries import labelled

    rows = labelled(spark, sf).withColumn("label", F.contains("message", F.lit(" the ")).cast("int"))
    detector, _ = train_detector(rows, ("row_id",), trees=3, max_depth=3, terms=50)
    inputs.packets(spark, sf).withColumn("src_ip", F.lit("8.8.8.8")).repartition(4).write.parquet(str(tmp_path / "in"))
    scored = jobs.stream_score(detector, stream_packets(spark, str(tmp_path / "in"), 2))
    finish(jobs.run_available(scored, str(tmp_path / "out"), str(tmp_path / "progress")))
    texts = lambda df: sorted(map(str, df.collect()))
    batch = score_packets(detector, read_packets(spark, str(tmp_path / "in")))
    assert texts(spark.read.parquet(str(tmp_path / "out"))) == texts(batch) and batch.count() > 0


def test_suggestions_survive_a_replay(spark, tmp_path):
    from alertloom.sources.suggestions import write_suggestions

    rules = spark.createDataFrame([("alert tcp (a; sid:1;)",), ("alert tcp (a; sid:2;)",), ("alert tcp (b;)",)], "rule string")
    store = str(tmp_path / "store")
    write_suggestions(rules, store)
    write_suggestions(rules, store)
    assert sorted(r["rule_key"] for r in spark.read.parquet(store).collect()) == ["alert tcp (a;)", "alert tcp (b;)"]


def test_only_folders_that_may_hold_a_rule_are_read(spark, tmp_path, monkeypatch):
    """Other folders are spoilt, and nobody notices; folders of known rules are read and the anti-join decides."""
    from alertloom.sources import suggestions

    store = tmp_path / "store"
    rules = lambda numbers: spark.createDataFrame([(f'alert tcp any any -> any 80 (content:"r{k}"; sid:{k};)',) for k in numbers], "rule string")
    suggestions.write_suggestions(rules(range(300)), str(store))
    keyed = suggestions._placed(rules(range(300)).select(suggestions.without_identity(F.col("rule")).alias("rule_key"), "rule")).collect()
    fresh = suggestions._placed(rules(range(300, 330)).select(suggestions.without_identity(F.col("rule")).alias("rule_key"), "rule"))
    again = [k for k in range(300) if keyed[k].bucket == 7][:3]
    for folder in store.glob("bucket=*"):
        if folder.name != "bucket=7":
            for part in folder.glob("*.parquet"):
                part.write_bytes(b"spoilt")
                (folder / f".{part.name}.crc").unlink(missing_ok=True)
    batch = rules([*again, *range(300, 330)]).select(suggestions.without_identity(F.col("rule")).alias("rule_key"), "rule")
    new = suggestions.new_suggestions(batch, str(store))
    assert {r.rule for r in new.collect()} == {r.rule for r in fresh.collect()}
    # Full filters exclude nothing; then every folder of the batch would have to be read.
    monkeypatch.setattr(suggestions, "_filters_of", lambda store: store + "/none")
    with pytest.raises(Exception, match="(?i)parquet"):
        suggestions.new_suggestions(batch, str(store)).collect()


def test_verdicts_before_anything_arrived(spark, tmp_path):
    expected = spark.createDataFrame([(1, at(0), 5)], "sid long, since timestamp, wait_seconds int")
    stream = jobs.VerifyStream(expected, str(tmp_path / "none"), 2024)
    assert [(r["passed"], r["final"]) for r in stream.verdicts().collect()] == [(False, False)]
    assert [(r["passed"], r["final"]) for r in stream.verdicts(ended=True).collect()] == [(False, True)]
    assert stream.failures(ended=True)[0].count() == 0
    assert jobs.VerifyStream(expected.limit(0), str(tmp_path / "none"), 2024).verdicts().count() == 0


def test_failures_become_final_behind_the_watermark(spark, tmp_path):
    """A rule has failed once the watermark passes its window; late lines are dropped; a replayed batch changes nothing."""
    expected = spark.createDataFrame([(22, at(100), 5), (23, at(100), 5), (24, at(101), 5), (25, at(500), 5)], "sid long, since timestamp, wait_seconds int")
    line = lambda sid, t: f'{at(t).strftime("%m/%d-%H:%M:%S.%f")} [**] [1:{sid}:1] "m" [**] {{TCP}} 1.1.1.1:5 -> 2.2.2.2:80'
    stream = jobs.VerifyStream(expected, str(tmp_path / "state"), 2024, delay_seconds=3)
    seen = lambda: {r.sid: (r.passed, r.final) for r in stream.verdicts().collect()}
    batches = [[(9, 101), (9, 90)], [(23, 104), (9, 106)], ["noise"], [(9, 109)], [(22, 103), (25, 504)]]
    states = []
    for k, batch in enumerate(batches):
        lines = [(b if isinstance(b, str) else line(*b),) for b in batch]
        (tmp_path / "in").mkdir(exist_ok=True)
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        finish(stream.start(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "progress")))
        states.append(seen())
    assert states[0] == {22: (False, False), 23: (False, False), 24: (False, False), 25: (False, False)}
    assert states[1] == states[2] == states[0] | {23: (True, True)}
    assert states[3] == {22: (False, True), 23: (True, True), 24: (False, True), 25: (False, False)}
    # The late line of rule 22 does not change what is final.
    assert states[4] == states[3] | {25: (True, True)} and stream.late_rows() == 1
    found, ranges = stream.failures()
    from alertloom.operators.joins import expand_lines

    assert found.count() == 3
    assert sorted((r.expected_sid, r.event_ts) for r in expand_lines(found, ranges).collect()) == [(22, at(101)), (22, at(104)), (24, at(104)), (24, at(106))]
    stream.judge(spark.createDataFrame([(line(25, 504),), (line(22, 103),)], "value string"), 4)
    assert seen() == states[4] and stream.late_rows() == 1


def test_lines_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    """A batch is dealt out to the cores, however few files it comes in."""
    expected = spark.createDataFrame([(1, at(0), 5000)], "sid long, since timestamp, wait_seconds int")
    stream = jobs.VerifyStream(expected, str(tmp_path / "state"), 2024)
    lines = [(f'{at(1 + k).strftime("%m/%d-%H:%M:%S.%f")} [**] [1:2:1] "m" [**] {{TCP}} 1.1.1.1:5 -> 2.2.2.2:80',) for k in range(400)]
    stream.judge(spark.createDataFrame(lines, "value string").coalesce(1), 0)
    written = spark.read.parquet(f"{tmp_path}/state/alerts")
    assert written.count() == 400 and len(written.inputFiles()) == spark.sparkContext.defaultParallelism
