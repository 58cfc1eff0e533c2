"""Packets: filters, rule matching, service tags, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import network
from alertloom.operators import filters, joins, reports, thresholds
from alertloom.plans.jobs import detection_job, verified_detection
from alertloom.runtime import scratch_path, settle
from alertloom.sources.packets import read_packets
from alertloom.sources.rules import read_rules
from checks import inputs
from checks.registry import query
from checks.tables import sql


@query(
    "S11_read_packets",
    sql(
        """SELECT packet_id, epoch_us(ts) AS ts_us, protocol, src_ip, dst_ip, dst_port::BIGINT AS dst_port, tcp_flags, to_server, established,
        strlen(raw_text) + CASE WHEN text IS NULL AND raw_text IS NOT NULL THEN 1 ELSE 0 END AS bytes FROM packets""",
        "packets",
    ),
)
def s11(spark, sf):
    path = scratch_path(spark, "packets")
    inputs.packets(spark, sf).write.parquet(path)
    return read_packets(spark, path).select(
        "packet_id", F.unix_micros("ts").alias("ts_us"), "protocol", "src_ip", "dst_ip", F.col("dst_port").cast("long"),
        "tcp_flags", "to_server", "established", F.octet_length("payload").cast("long").alias("bytes"),
    )


def ids(df):
    return df.select("packet_id")


@query("P15_decode_payload", sql("SELECT packet_id, length(text) AS chars, md5(text) AS digest FROM packets WHERE text IS NOT NULL", "packets"))
def p15(spark, sf):
    text = network.decode_payload(F.col("payload"))
    decoded = inputs.packets(spark, sf).select("packet_id", text.alias("text")).where("text IS NOT NULL")
    return decoded.select("packet_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("F1_in_cidr", sql("SELECT packet_id, user_id < 60 AS inside FROM packets", "packets"))
def f1(spark, sf):
    return inputs.packets(spark, sf).select("packet_id", network.in_cidr(F.col("src_ip"), "192.168.1.0/24").alias("inside"))


@query("F2_from_outside", sql("SELECT packet_id FROM outside", "packets", "outside"))
def f2(spark, sf):
    return ids(inputs.packets(spark, sf).where(filters.from_outside(F.col("src_ip"))))


@query("F3_is_transport", sql("SELECT packet_id FROM packets WHERE protocol <> 'icmp'", "packets"))
def f3(spark, sf):
    return ids(inputs.packets(spark, sf).where(filters.is_transport(F.col("protocol"))))


@query("F4_not_management", sql("SELECT packet_id FROM packets WHERE dst_port NOT IN (22, 514)", "packets"))
def f4(spark, sf):
    return ids(inputs.packets(spark, sf).where(filters.not_management(F.col("dst_port"))))


@query("F5_long_enough", sql("SELECT packet_id FROM packets WHERE length(text) >= 5", "packets"))
def f5(spark, sf):
    return ids(inputs.packets(spark, sf).where(filters.long_enough(network.decode_payload(F.col("payload")))))


@query("F6_is_printable", r"SELECT doc_id FROM documents WHERE regexp_full_match(text, '[\x20-\x7e\t\n\r\x0b\x0c]+')")
def f6(spark, sf):
    return inputs.table(spark, sf, "documents").where(network.is_printable(F.col("text"))).select("doc_id")


INSPECTED = ("packets", "outside", "inspected")


@query("F7_inspectable", sql("SELECT packet_id, src_ip, dst_port::BIGINT AS dst_port, protocol, md5(message) AS digest FROM inspected", *INSPECTED))
def f7(spark, sf):
    kept = filters.inspectable(inputs.packets(spark, sf))
    return kept.select("packet_id", "src_ip", F.col("dst_port").cast("long"), "protocol", F.md5("message").alias("digest"))


@query("J1_match_rules", sql("SELECT packet_id, sid, rev, msg FROM matches", "packets", "matches"))
def j1(spark, sf):
    return joins.match_rules(inputs.packets(spark, sf), inputs.rules(spark)).select("packet_id", "sid", "rev", "msg")


#: Rules that matching cannot judge, one shape per ``event_id % 16``, with the reason; the last two are whole.
ODD_RULES = (
    ('alert tcp any any -> any 80 (pcre:"/evil/"; sid:{};)', "option pcre"),
    ('alert tcp any any -> any 80 (flow:to_client; sid:{};)', "flow"),
    ('alert tcp any any -> any 80 (dsize:>1000; sid:{};)', "option dsize"),
    ('alert tcp any any -> any 80 (content:" the ",offset 500; sid:{};)', "content form"),
    ('alert icmp any any -> any any (itype:>10; sid:{};)', "itype"),
    ('alert tcp any any -> any 80 (content:"|20 74 68 65 20|"; sid:{};)', "content form"),
    ('alert tcp any any -> any [80,443] (msg:"x"; sid:{};)', "port list or range"),
    ('alert tcp any any -> any 80 (content:!" the "; sid:{};)', "negated content"),
    ('alert tcp any any -> any 80 (detection_filter: track by_src, count 0, seconds 5; sid:{};)', "threshold"),
    ('alert tcp any any -> any 80 (flags:F+; sid:{};)', "flags"),
    ('pass tcp any any -> any 80 (msg:"x"; sid:{};)', "action"),
    ('alert http any any -> any 80 (msg:"x"; sid:{};)', "protocol"),
    ('alert tcp any any -> any 80 (msg:"x" sid:{})', "unreadable options"),
    ('alert tcp any any -> 10.0.0.0/40 80 (msg:"x"; sid:{};)', "unknown network"),
    ('alert tcp any any -> 1.2.3.4 80 (msg:"x"; sid:{};)', None),
    ('alert udp 9.9.9.9 any -> any any (content:" the ", nocase, fast_pattern; classtype:x; sid:{};)', None),
)


@query(
    "J1_unusable_rules",
    "SELECT CASE WHEN event_id % 16 <> 12 THEN event_id END AS sid, CASE event_id % 16 "
    + " ".join(f"WHEN {k} THEN '{reason}'" for k, (_, reason) in enumerate(ODD_RULES) if reason) + " END AS reason, 0::BIGINT AS matches FROM events WHERE event_id % 16 < 14",
)
def j1_unusable(spark, sf):
    """Rules with a part that is not evaluated are listed with the reason, and none of them matches a packet."""
    line = F.lit("")
    for k, (rule, _) in enumerate(ODD_RULES):
        before, after = rule.split("{}")
        line = F.when(F.col("event_id") % 16 == k, F.concat(F.lit(before), F.col("event_id").cast("string"), F.lit(after))).otherwise(line)
    path = scratch_path(spark, "rules")
    inputs.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    # Matched and listed, so read once.
    rules = settle(read_rules(spark, path), "rules")
    fired = joins.match_rules(inputs.packets(spark, sf), rules).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    return joins.unusable_rules(rules).join(fired, "sid", "left").select("sid", "reason", F.coalesce("n", F.lit(0)).alias("matches"))


PIECE = "[A-Za-z ,.]{12,40}"


@query(
    "J1_many_rules",
    sql(
        f"""SELECT packet_id, sid FROM (SELECT packet_id, event_id % (SELECT count(*) FROM documents) AS doc_id, protocol, text IS NOT NULL AND raw_text = '' AS empty, raw_text FROM packets
          JOIN events ON event_id = packet_id) p
        JOIN (SELECT d.doc_id, r.doc_id AS sid, d.text FROM documents d JOIN (SELECT doc_id, regexp_extract(text, '{PIECE}') AS piece FROM documents) r
          ON piece <> '' AND CASE WHEN r.doc_id % 2 = 0 THEN contains(d.text, piece) ELSE contains(lower(d.text), lower(piece)) END) m
        USING (doc_id) WHERE protocol = CASE WHEN sid % 3 = 0 THEN 'udp' ELSE 'tcp' END AND raw_text = m.text""",
        "packets",
    ),
)
def j1_many(spark, sf):
    """A rule for each document, with a piece of its text, so the rules grow with the table."""
    piece, n = F.regexp_extract("text", PIECE, 0), F.col("doc_id")
    head = F.concat(F.lit("alert "), F.when(n % 3 == 0, "udp").otherwise("tcp"), F.lit(' any any -> any any (content:"'), piece, F.lit('"'))
    line = F.concat(head, F.when(n % 2 == 1, ", nocase").otherwise(""), F.lit("; sid:"), n.cast("string"), F.lit(";)"))
    path = scratch_path(spark, "rules")
    inputs.table(spark, sf, "documents").where(piece != "").select(line.alias("value")).write.text(path)
    return joins.match_rules(inputs.packets(spark, sf), read_rules(spark, path)).select("packet_id", "sid")


@query("W1_thresholds_of_rules", sql("SELECT packet_id, sid FROM detected", "packets", "matches", "detected"))
def w1_rules(spark, sf):
    matched = joins.match_rules(inputs.packets(spark, sf), inputs.rules(spark)).drop("payload")
    return thresholds.detection_filters(settle(matched)).select("packet_id", "sid")


@query(
    "C6_detection_job",
    sql(
        """SELECT packet_id, sid, msg, src_ip FROM detected WHERE sid <> 1000006 AND NOT (sid = 1000004 AND src_ip = '10.0.0.70')""",
        "packets", "matches", "detected",
    ),
)
def c6(spark, sf):
    listed = spark.createDataFrame(
        [(1, 1000006, None, None), (1, 1000004, "by_src", "10.0.0.70")], "gid int, sid long, track string, ip string"
    )
    alerts = detection_job(inputs.packets(spark, sf), inputs.rules(spark), listed)
    return alerts.select("packet_id", "sid", "msg", "src_ip")


@query(
    "C6_verified_detection",
    sql(
        """SELECT r.sid::BIGINT AS sid, r.since_s::BIGINT AS since_s, count(packet_id) > 0 AS passed, arg_min(msg, packet_id) AS first_line
        FROM (SELECT 1000001 + k AS sid, 1704067200 + 86400 * (3 * k + 1) AS since_s FROM range(7) t(k)) r
        LEFT JOIN (SELECT * FROM detected WHERE sid <> 1000006) d ON d.sid = r.sid AND epoch_us(ts) > since_s * 1000000 AND epoch_us(ts) <= (since_s + 7200) * 1000000 GROUP BY ALL""",
        "packets", "matches", "detected",
    ),
)
def c6_verified(spark, sf):
    """Packets from files, rules, thresholds, suppression, and whether each expected rule fired in its two hours."""
    path = scratch_path(spark, "packets")
    inputs.packets(spark, sf).write.parquet(path)
    listed = spark.createDataFrame([(1, 1000006, None, None)], "gid int, sid long, track string, ip string")
    k = F.col("id")
    expected = spark.range(7).select((1000001 + k).alias("sid"), F.timestamp_seconds(1704067200 + 86400 * (3 * k + 1)).alias("since"), F.lit(7200).alias("wait_seconds"))
    verdicts = verified_detection(read_packets(spark, path), inputs.rules(spark), listed, expected)[1]
    return verdicts.select("sid", F.unix_seconds("since").alias("since_s"), "passed", "first_line")


BINDINGS = [("udp", "53", "dns"), ("tcp", "53", "dns"), ("tcp", "443 80", "web"), ("tcp", "2123 2152 3306", "gtp")]


@query(
    "J5_tag_service",
    sql(
        """SELECT packet_id, CASE WHEN dst_port = 53 AND protocol IN ('tcp', 'udp') THEN 'dns' WHEN protocol = 'tcp' AND dst_port IN (80, 443) THEN 'web'
        WHEN protocol = 'tcp' AND dst_port = 3306 THEN 'gtp' END AS service FROM packets""",
        "packets",
    ),
)
def j5(spark, sf):
    bindings = spark.createDataFrame(BINDINGS, "proto string, ports string, service string")
    return joins.tag_service(inputs.packets(spark, sf), bindings).select("packet_id", "service")


def write_rules(spark, sf):
    """A rules file with one line per event, in five shapes, with comments, blanks and repeats."""
    path = scratch_path(spark, "rules")
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    port = inputs.pick(F.col("event_id") % 4, inputs.PORTS).cast("string")
    shapes = (
        F.concat(F.lit("alert tcp any any -> $HOME_NET "), port, F.lit(' (msg:"A '), kind, F.lit('"; flow:to_server,established; content:"'), n,
                 F.lit('-", nocase; detection_filter: track by_src, count '), (F.col("event_id") % 7 + 1).cast("string"),
                 F.lit(", seconds 60; sid:"), n, F.lit("; rev:1;)")),
        F.concat(F.lit('alert tcp any 1024 -> $HOME_NET any (msg:"FIN '), n, F.lit('"; flags: F,1; sid:'), n, F.lit("; rev:2;)")),
        F.concat(F.lit('alert icmp any any -> $HOME_NET any (msg:"ping"; itype:8; icode:0; detection_filter: track by_dst, count 2, seconds 10; sid:'),
                 F.floor(F.col("event_id") / 50).cast("string"), F.lit("; rev:1;)")),
        F.concat(F.lit('alert udp any any -> $HOME_NET 3306 (content:"x; '), n, F.lit('\\r\\n"; content:"q\\"'), kind,
                 F.lit('"; msg:"Two; parts"; metadata: a b; sid:'), n, F.lit("; rev:1;)")),
        F.concat(F.lit("# comment "), n),
    )
    line = F.lit("")
    for k, shape in enumerate(shapes):
        line = F.when(F.col("event_id") % 6 == k, shape).otherwise(line)
    inputs.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return path


PARSED = """SELECT CASE k WHEN 2 THEN event_id // 50 ELSE event_id END AS sid, CASE k WHEN 1 THEN 2 ELSE 1 END AS rev,
    CASE k WHEN 2 THEN 'icmp' WHEN 3 THEN 'udp' ELSE 'tcp' END AS proto, '$HOME_NET' AS dst_net,
    CASE k WHEN 0 THEN CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 3306 ELSE 443 END WHEN 3 THEN 3306 END AS dst_port,
    CASE k WHEN 0 THEN 'A ' || event_type WHEN 1 THEN 'FIN ' || event_id WHEN 2 THEN 'ping' ELSE 'Two; parts' END AS msg,
    CASE k WHEN 0 THEN event_id || '-' WHEN 3 THEN 'x; ' || event_id || chr(13) || chr(10) || '|q"' || event_type ELSE '' END AS contents,
    CASE WHEN k = 0 THEN 1 ELSE 0 END AS nocase,
    CASE k WHEN 1 THEN 'F' END AS flags, CASE k WHEN 2 THEN 8 END AS itype, CASE k WHEN 2 THEN 0 END AS icode,
    CASE k WHEN 0 THEN 'to_server,established' END AS flow,
    CASE k WHEN 0 THEN 'by_src' WHEN 2 THEN 'by_dst' END AS df_track, CASE k WHEN 0 THEN event_id % 7 + 1 WHEN 2 THEN 2 END AS df_count,
    CASE k WHEN 0 THEN 60 WHEN 2 THEN 10 END AS df_seconds FROM (SELECT *, event_id % 6 AS k FROM events) WHERE k < 4"""


@query("S6_read_rules", PARSED)
def s6(spark, sf):
    rules = read_rules(spark, write_rules(spark, sf))
    return rules.select(
        "sid", "rev", "proto", "dst_net", "dst_port", "msg",
        F.array_join(F.transform("contents", lambda c: c["text"]), "|").alias("contents"),
        F.size(F.filter("contents", lambda c: c["nocase"])).alias("nocase"),
        "flags", "itype", "icode", F.array_join("flow", ",").alias("flow"), "df_track", F.col("df_count").cast("long"), "df_seconds",
    )


INVENTORY = f"""WITH r AS (SELECT *, md5(concat_ws('|', sid, rev, proto, dst_port, msg, contents, df_count)) AS rule_text FROM ({PARSED})),
    t AS (SELECT count(*) AS total, count(DISTINCT rule_text) AS chains FROM r)
    SELECT 'total rules' AS item, total AS rule_count FROM t UNION ALL SELECT 'duplicate rules', total - chains FROM t
    UNION ALL SELECT proto || CASE WHEN msg LIKE 'FIN%' THEN ' src' WHEN dst_port IS NULL THEN ' any' ELSE ' dst' END, count(*) FROM r GROUP BY 1"""


@query("A5_rule_inventory", INVENTORY)
def a5(spark, sf):
    return reports.rule_inventory(read_rules(spark, write_rules(spark, sf)))
