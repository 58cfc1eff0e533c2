"""Alerts: parsing, typed views, reports, suppression, verification, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import parsing
from alertloom.operators import alerts as A, dedup, joins, numbering, thresholds
from alertloom.runtime import scratch_path, settle
from alertloom.sources.alerts import read_alert_lines, read_alert_table, read_alerts_for_mining, write_alerts
from alertloom.plans.jobs import alerts_job
from checks import inputs
from checks.registry import query
from checks.tables import KIND, SOURCE, sql

EIGHT = ", ".join(f'"{f}"' for f in parsing.FIELDS)
NOTED = f"pos, {EIGHT}"


def written_lines(spark, sf):
    """Alert lines as three log files below the shared folder."""
    path = scratch_path(spark, "logs")
    inputs.alert_lines(spark, sf).select("file", "value").write.partitionBy("file").text(path)
    return [f"{path}/file=log{k}" for k in range(3)]


@query("S1_read_alert_lines", sql("SELECT file, value, right(file, 1)::INT AS file_index FROM lines", "lines"))
def s1(spark, sf):
    lines = read_alert_lines(spark, written_lines(spark, sf) + ["/no/such/log"])
    return lines.select(F.regexp_extract("file", "file=(log[0-9])", 1).alias("file"), "value", "file_index")


@query("S2_write_alerts", sql(f"SELECT {EIGHT} FROM alerts", "alerts"))
def s2(spark, sf):
    path = scratch_path(spark, "alerts")
    write_alerts(A.parse_alerts(inputs.alert_lines(spark, sf)), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("S5_read_alert_table", sql(f"SELECT {EIGHT}, 1 AS label FROM alerts", "alerts"))
def s5(spark, sf):
    path = scratch_path(spark, "alerts")
    write_alerts(A.parse_alerts(inputs.alert_lines(spark, sf)), path)
    return read_alert_table(spark, path)


@query("S5_read_alerts_for_mining", sql("SELECT message, dest_port, 1 AS label FROM alerts", "alerts"))
def s5_mining(spark, sf):
    path = scratch_path(spark, "alerts")
    alerts = A.parse_alerts(inputs.alert_lines(spark, sf))
    alerts.withColumnsRenamed({"message": " Message", "dest_port": "Dest_Port "}).write.option("header", True).csv(path)
    return read_alerts_for_mining(spark, path).select("message", "dest_port", "label")


@query("P1_parse_syslog_alert", sql(f"SELECT {NOTED} FROM alerts WHERE pos % 2 = 0", "alerts"))
def p1(spark, sf):
    return A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",), formats=(parsing.SYSLOG,))


@query("P2_parse_fast_alert", sql(f"SELECT {NOTED} FROM alerts WHERE pos % 2 = 1", "alerts"))
def p2(spark, sf):
    return A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",), formats=(parsing.FAST,))


@query("P3_parse_alerts", sql(f"SELECT {NOTED} FROM alerts", "alerts"))
def p3(spark, sf):
    return A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",))


@query("P3_rejected_lines", sql("SELECT pos, value FROM lines WHERE starts_with(value, 'noise')", "lines"))
def p3_rejects(spark, sf):
    return A.rejected_lines(inputs.alert_lines(spark, sf)).select("pos", "value")


@query("P4_default_ports", sql("SELECT source_port, dest_port, count(*) AS n FROM alerts GROUP BY ALL", "alerts"))
def p4(spark, sf):
    return A.parse_alerts(inputs.alert_lines(spark, sf)).groupBy("source_port", "dest_port").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P5_split_signature",
    sql("SELECT pos, 1::BIGINT AS gid, split_part(signature_id, ':', 2)::BIGINT AS sid, 1::BIGINT AS rev FROM alerts", "alerts"),
)
def p5(spark, sf):
    alerts = A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",))
    return alerts.select("pos", *parsing.split_signature(F.col("signature_id")))


TYPED = f"""SELECT event_id AS pos,
    epoch_us(ts) + CASE WHEN event_id % 2 = 0 THEN 6 * 3600 * 1000000::BIGINT ELSE 0 END AS event_us,
    1::BIGINT AS gid, (1000000 + {KIND})::BIGINT AS sid, 1::BIGINT AS rev,
    CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1024 + event_id % 60000 END AS source_port
    FROM events WHERE event_id % 10 <> 9"""


@query("P3_typed_alerts", TYPED)
def p3_typed(spark, sf):
    alerts = A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",))
    typed = A.typed_alerts(alerts, year=2024, keep=("pos",))
    return typed.select("pos", F.unix_micros("event_ts").alias("event_us"), "gid", "sid", "rev", F.col("source_port").cast("long"))


@query("P24_format_alert", sql("SELECT pos, value FROM lines WHERE pos % 10 <> 9 AND pos % 2 = 0", "lines"))
def p24(spark, sf):
    """Parse the lines and write the syslog ones again."""
    parsed = A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",), formats=(parsing.SYSLOG,))
    fields = [F.col(f) for f in parsing.FIELDS]
    return parsed.select("pos", parsing.format_alert(fields[0], F.lit("kali"), *fields[1:]).alias("value"))


@query("A2_file_counts", sql("SELECT file, count(*) AS row_count FROM alerts GROUP BY file", "alerts"))
def a2(spark, sf):
    return A.file_counts(A.parse_alerts(inputs.alert_lines(spark, sf), keep=("file",)))


@query(
    "A2_log_counts",
    sql(
        """SELECT file, true AS found, count(*) AS lines, count(*) FILTER (NOT starts_with(value, 'noise')) AS alerts, count(*) FILTER (starts_with(value, 'noise')) AS rejects
        FROM lines GROUP BY file UNION ALL SELECT 'garbage', true, count(*), 0, count(*) FROM lines WHERE starts_with(value, 'noise')
        UNION ALL SELECT 'empty', true, 0, 0, 0 UNION ALL SELECT 'log', false, 0, 0, 0""",
        "lines",
    ),
)
def a2_logs(spark, sf):
    """Logs without an alert, without a line, and one that is missing are counted too."""
    paths = written_lines(spark, sf)
    root = paths[0].rsplit("/", 1)[0]
    noise = inputs.alert_lines(spark, sf).where(F.startswith("value", F.lit("noise"))).select("value")
    noise.write.text(f"{root}/file=garbage")
    noise.limit(0).write.text(f"{root}/file=empty")
    counts = A.log_counts(spark, [f"{root}/file=garbage", *paths, f"{root}/file=empty", "/no/such/log"])
    return counts.select(F.regexp_extract("path", "(?:file=|/)(\\w+)$", 1).alias("file"), "found", "lines", "alerts", "rejects")


SUMMARY = """SELECT 1::BIGINT AS gid, split_part(signature_id, ':', 2)::BIGINT AS sid, 1::BIGINT AS rev, message, protocol,
    dest_port::BIGINT AS dest_port, count(*) AS alerts, count(DISTINCT source_ip) AS sources,
    strftime(min(event_ts), '%Y-%m-%dT%H:%M:%S.%f') AS first_seen, strftime(max(event_ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_seen
    FROM (SELECT a.*, make_timestamp(epoch_us(ts) + CASE WHEN pos % 2 = 0 THEN 21600000000 ELSE 0 END) AS event_ts
      FROM {} a JOIN events ON event_id = pos) GROUP BY ALL"""


@query("A6_alert_summary", sql(SUMMARY.format("alerts"), "alerts"))
def a6(spark, sf):
    return A.alert_summary(A.typed_alerts(A.parse_alerts(inputs.alert_lines(spark, sf)), 2024))


@query("C1_alerts_job", sql(SUMMARY.format("kept_alerts"), "alerts", "kept_alerts"))
def c1(spark, sf):
    return alerts_job(inputs.alert_lines(spark, sf), inputs.suppressions(spark), 2024)


@query("J2_suppress", sql(f"SELECT {NOTED} FROM kept_alerts", "alerts", "kept_alerts"))
def j2(spark, sf):
    alerts = A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",))
    keyed = alerts.withColumns({c: parsing.signature_part(F.col("signature_id"), k) for k, c in enumerate(("gid", "sid"))})
    return joins.suppress(keyed, inputs.suppressions(spark)).select("pos", *parsing.FIELDS)


@query(
    "D1_distinct_attacks",
    sql("SELECT message, dest_port, min(pos) AS pos, arg_min(source_ip, pos) AS source_ip FROM alerts GROUP BY message, dest_port", "alerts"),
)
def d1(spark, sf):
    alerts = A.parse_alerts(inputs.alert_lines(spark, sf), keep=("pos",))
    return dedup.distinct_attacks(alerts, carry=("source_ip",))


# Rule checks: one per user, the rule number and the start follow from the user.
EXPECTED = """expected AS (SELECT DISTINCT 1000001 + user_id % 6 AS sid, TIMESTAMP '2024-01-01' + to_hours(user_id::BIGINT % 700) AS since,
    60 * (1 + user_id % 40) AS wait_seconds FROM events)"""
ARRIVED = """arrived AS (SELECT l.pos, l.value AS line, split_part(signature_id, ':', 2)::BIGINT AS sid,
    make_timestamp(epoch_us(ts) + CASE WHEN l.pos % 2 = 0 THEN 21600000000 ELSE 0 END) AS event_ts
    FROM lines l JOIN alerts a USING (pos) JOIN events e ON e.event_id = l.pos)"""
VERDICTS = """SELECT sid::BIGINT AS sid, epoch(since)::BIGINT AS since_s, wait_seconds::BIGINT AS wait_seconds, count(line) > 0 AS passed,
    arg_min(line, pos) AS first_line FROM expected LEFT JOIN (SELECT sid AS asid, event_ts, line, pos FROM arrived) ON asid = sid
    AND event_ts > since AND event_ts <= since + to_seconds(wait_seconds) GROUP BY 1, 2, 3"""


def expected_rules(spark, sf):
    user = F.col("user_id")
    since = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01T00:00:00Z").cast("timestamp")) + (user % 700) * 3600)
    return inputs.table(spark, sf, "events").select(
        (1000001 + user % 6).alias("sid"), since.alias("since"), (60 * (1 + user % 40)).cast("int").alias("wait_seconds")
    ).distinct()


def arrived_alerts(spark, sf):
    lines = inputs.alert_lines(spark, sf)
    alerts = A.parse_alerts(lines, keep=("pos", "value"))
    return A.typed_alerts(alerts, 2024, keep=("pos", "value")).withColumnRenamed("value", "line")


@query("J4_verify_rules", sql("", "lines", "alerts").rstrip() + f", {EXPECTED}, {ARRIVED} {VERDICTS}")
def j4(spark, sf):
    verdicts = joins.verify_rules(expected_rules(spark, sf), arrived_alerts(spark, sf))
    return verdicts.select("sid", F.unix_seconds("since").alias("since_s"), F.col("wait_seconds").cast("long"), "passed", "first_line")


@query(
    "J4_new_lines",
    sql("", "lines", "alerts").rstrip() + f""", {EXPECTED}, {ARRIVED}, verdicts AS ({VERDICTS})
    SELECT v.sid, since_s, pos FROM verdicts v JOIN arrived a ON NOT passed AND epoch_us(event_ts) > since_s * 1000000
    AND epoch_us(event_ts) <= (since_s + wait_seconds) * 1000000""",
)
def j4_lines(spark, sf):
    alerts = settle(arrived_alerts(spark, sf))
    failed = joins.verify_rules(expected_rules(spark, sf), alerts).where("NOT passed")
    found = joins.new_lines(failed, alerts)
    return found.select(F.col("expected_sid").alias("sid"), F.unix_seconds("since").alias("since_s"), "pos")


PIECES = f"""{EXPECTED}, {ARRIVED}, verdicts AS ({VERDICTS}), failed AS (SELECT sid, since_s, since_s + wait_seconds AS until_s FROM verdicts WHERE NOT passed),
    bounds AS (SELECT bound, row_number() OVER (ORDER BY bound) AS piece FROM (SELECT since_s AS bound FROM failed UNION SELECT until_s FROM failed))"""


@query(
    "J4_lines_once",
    sql("", "lines", "alerts").rstrip() + f""", {PIECES}
    SELECT pos, (SELECT count(*) FROM bounds WHERE bound * 1000000 < epoch_us(event_ts)) AS piece FROM arrived
    WHERE EXISTS (FROM failed WHERE since_s * 1000000 < epoch_us(event_ts) AND until_s * 1000000 >= epoch_us(event_ts))""",
)
def j4_once(spark, sf):
    """Each line of the failed rules' windows once, with the piece of time it lies in."""
    return failed_pieces(spark, sf)[0].select("pos", "piece")


@query(
    "J4_pieces_of_rules",
    sql("", "lines", "alerts").rstrip() + f""", {PIECES}
    SELECT sid, since_s, a.piece AS first_piece, b.piece - 1 AS last_piece FROM failed JOIN bounds a ON a.bound = since_s JOIN bounds b ON b.bound = until_s""",
)
def j4_pieces(spark, sf):
    ranges = failed_pieces(spark, sf)[1]
    return ranges.select(F.col("expected_sid").alias("sid"), F.unix_seconds("since").alias("since_s"), "first_piece", "last_piece")


def failed_pieces(spark, sf):
    alerts = settle(arrived_alerts(spark, sf))
    failed = joins.verify_rules(expected_rules(spark, sf), alerts).where("NOT passed")
    return joins.windows_in_pieces(failed, alerts.select("event_ts", "line", "pos"))


@query(
    "W1_detection_filter",
    f"""WITH a AS (SELECT event_id, ts, {KIND} AS sid, {SOURCE} AS src_ip FROM events)
    SELECT event_id, sid, src_ip FROM (SELECT *, count(*) OVER (PARTITION BY sid, src_ip ORDER BY epoch_us(ts)
    RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS n FROM a) WHERE n >= 2""",
)
def w1(spark, sf):
    matches = inputs.table(spark, sf, "events").select("event_id", "ts", inputs.type_number().alias("sid"), inputs.source_ip().alias("src_ip"))
    return thresholds.detection_filter(matches, "src_ip", 2, 43200).select("event_id", "sid", "src_ip")


FILTERED = f"""WITH a AS (SELECT event_id, ts, {KIND} AS sid, {SOURCE} AS src_ip FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid, src_ip, epoch_us(ts) // 172800000000 ORDER BY ts, event_id) AS n FROM a)
    SELECT event_id, sid FROM r WHERE CASE sid WHEN 1 THEN n <= 2 WHEN 2 THEN n = 2 ELSE true END"""


@query("W2_event_filter", FILTERED)
def w2(spark, sf):
    alerts = inputs.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("event_ts"), F.lit(1).alias("gid"), inputs.type_number().alias("sid"), inputs.source_ip().alias("src_ip")
    )
    order = ("event_ts", "event_id")
    limited = thresholds.event_filter(alerts, 1, 1, "limit", "src_ip", 2, 172800, order)
    return thresholds.event_filter(limited, 1, 2, "both", "src_ip", 2, 172800, order).select("event_id", "sid")


@query(
    "W3_rate_filter",
    f"""WITH a AS (SELECT event_id, epoch_us(ts) AS t, {KIND} AS sid, {SOURCE} AS src_ip FROM events),
    c AS (SELECT *, count(*) OVER (PARTITION BY sid, src_ip ORDER BY t RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW) >= 2 AS over FROM a),
    h AS (SELECT *, max(over::INT) OVER (PARTITION BY sid, src_ip ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) = 1 AS held FROM c)
    SELECT event_id, sid, CASE WHEN sid = 3 AND held THEN 'drop' ELSE 'alert' END AS action FROM h""",
)
def w3(spark, sf):
    alerts = inputs.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("event_ts"), F.lit(1).alias("gid"), inputs.type_number().alias("sid"),
        inputs.source_ip().alias("src_ip"), F.lit("alert").alias("action"),
    )
    return thresholds.rate_filter(alerts, 1, 3, "src_ip", 2, 172800, "drop", 86400).select("event_id", "sid", "action")


@query(
    "F10_of_facility",
    "SELECT event_id, event_type FROM events WHERE event_id % 3 = 1",
)
def f10(spark, sf):
    from alertloom.operators.filters import of_facility

    tagged = inputs.table(spark, sf, "events").withColumn("facility", F.concat(F.lit("local"), (F.col("event_id") % 3 + 4).cast("string")))
    return of_facility(tagged).select("event_id", "event_type")


@query("W4_sequence_numbers", "SELECT event_id, 1000100 - 1 + row_number() OVER (ORDER BY event_id) AS sid FROM events")
def w4(spark, sf):
    events = inputs.table(spark, sf, "events").select("event_id")
    return numbering.number_rows(events, ["event_id"], 1000100, "sid")
