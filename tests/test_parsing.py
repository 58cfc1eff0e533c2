from pyspark.sql import functions as F

from alertloom.functions import parsing
from alertloom.operators.alerts import parse_alerts, rejected_lines, typed_alerts
from alertloom.sources.alerts import read_alert_lines, write_alerts

SQL_LINE = '2025-12-03T20:22:05-06:00 kali snort: [1:1764814600:1] "Possible SQL Injection" {UDP} 192.168.1.6:37609 -> 192.168.1.44:3306'


def parsed(spark, *lines):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "pos int, value string")
    return {r["pos"]: r for r in parse_alerts(df, keep=("pos",)).collect()}


def test_recorded_line(spark):
    row = parsed(spark, SQL_LINE)[0]
    assert tuple(row)[1:] == (
        "2025-12-03T20:22:05-06:00", "1:1764814600:1", "Possible SQL Injection", "UDP", "192.168.1.6", "37609", "192.168.1.44", "3306",
    )


def test_edges(spark):
    rows = parsed(
        spark,
        SQL_LINE.replace("-06:00", "Z"),
        SQL_LINE.replace("192.168.1.6:", "999.1.1.1:"),
        SQL_LINE.replace("192.168.1.6:37609", "fe80::1"),
        "<165>1 " + SQL_LINE + " trailing",
        SQL_LINE.replace("Possible SQL", 'a "quoted" word'),
        '10/24-12:00:00.123456 [**] [1:1000004:1] "ICMP Ping" [**] [Classification: a b] [Priority: 2] {ICMP} 10.0.0.1 -> 10.0.0.2',
        "",
        SQL_LINE.replace("Possible", "odd ﷐ mark"),
        '10/24-12:00:00.1 [**] [1:1:1] "both" {TCP} 1.1.1.1:1 -> 2.2.2.2:2 ' + SQL_LINE,
    )
    assert sorted(rows) == [1, 3, 4, 5, 7, 8]
    assert rows[1]["source_ip"] == "999.1.1.1"
    assert rows[4]["message"] == 'a "quoted" word Injection'
    assert (rows[5]["source_port"], rows[5]["dest_port"], rows[5]["protocol"]) == ("0", "0", "ICMP")
    assert rows[7]["message"] == "odd � mark SQL Injection"
    # The syslog form wins wherever it stands in the line.
    assert rows[8]["message"] == "Possible SQL Injection"


def test_rejects_are_the_complement(spark):
    df = spark.createDataFrame([(SQL_LINE,), ("noise",), (None,)], "value string")
    assert rejected_lines(df).count() == 2 and parse_alerts(df).count() == 1


def test_line_is_matched_once(spark):
    df = spark.createDataFrame([(SQL_LINE,)], "value string")
    plan = parse_alerts(df).where("message like '%SQL%'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_round_trip(spark):
    alert = parse_alerts(spark.createDataFrame([(SQL_LINE,)], "value string"))
    c = [F.col(f) for f in parsing.FIELDS]
    assert alert.select(parsing.format_alert(c[0], F.lit("kali"), *c[1:])).first()[0] == SQL_LINE


def test_typed_view(spark):
    rows = parsed(spark, SQL_LINE, '10/24-12:00:00.123456 [**] [1:7:3] "x" {ICMP} 10.0.0.1 -> 10.0.0.2').values()
    df = spark.createDataFrame([tuple(r)[1:] for r in rows], ", ".join(f"{f} string" for f in parsing.FIELDS))
    got = typed_alerts(df, 2024, "-05:00").orderBy("sid").select(F.unix_micros("event_ts"), "gid", "sid", "rev", "source_port").collect()
    assert tuple(got[0]) == (1729789200123456, 1, 7, 3, 0)
    assert tuple(got[1])[1:] == (1, 1764814600, 1, 37609)


def test_read_lines(spark, tmp_path):
    first, second = tmp_path / "log1", tmp_path / "log10"
    first.write_bytes(SQL_LINE.encode() + b"\nbad \xff byte\n")
    second.write_text("one\ntwo\n")
    lines = read_alert_lines(spark, [str(second), str(first), str(tmp_path / "missing")])
    got = [(r["file_index"], r["value"]) for r in lines.orderBy("file_index", "block", "seq").collect()]
    assert got == [(0, "one"), (0, "two"), (1, SQL_LINE), (1, "bad � byte")]
    assert read_alert_lines(spark, ["/no/such"]).count() == 0


def test_nothing_is_written_for_no_alerts(spark, tmp_path):
    empty = parse_alerts(spark.createDataFrame([("noise",)], "value string"))
    assert write_alerts(empty, str(tmp_path / "out")) is False
    assert not (tmp_path / "out").exists()


def test_mining_reads_in_file_order(spark, tmp_path):
    from alertloom.plans.jobs import mining_job, mining_prompts
    from alertloom.sources.alerts import read_alerts_for_mining

    names = ["zeta", "alpha payload=x y", "Generic x", "mid", "zeta", "alpha payload=x y", "mid"]
    text = " Message,Dest_Port \n" + "".join(f"{n},{80 + k % 2}\n" for k, n in enumerate(names))
    (tmp_path / "a.csv").write_text(text)
    prompts = mining_prompts(read_alerts_for_mining(spark, str(tmp_path / "a.csv")))
    rows = prompts.orderBy("prompt_id").collect()
    assert [(r["message"], r["dest_port"]) for r in rows] == [("zeta", "80"), ("alpha payload=x y", "81"), ("mid", "81"), ("mid", "80")]
    assert '"x"' in rows[1]["prompt"]
    answers = prompts.select("prompt_id", F.concat(F.lit("alert tcp ("), "message", F.lit(";)")).alias("response"))
    rules = {r["message"] + r["rule"][-20:]: r["sid"] for r in mining_job(prompts, answers).collect()}
    assert sorted(rules.values()) == [1000100, 1000101, 1000102, 1000103]
    first = [r["message"] for r in mining_job(prompts, answers).orderBy("sid").collect()]
    assert first == ["zeta", "alpha payload=x y", "mid", "mid"]


def test_order_over_part_files(spark, tmp_path):
    from alertloom.sources.alerts import with_order, with_position

    for k in range(4):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k * 100 + i:04d}\n" for i in range(100)))
    lines = spark.read.option("maxPartitionBytes", 64).text(str(tmp_path))
    got = [r["value"] for r in with_order(with_position(lines, "value")).orderBy("pos").collect()]
    assert got == [f"{k:04d}" for k in range(400)]
