"""Inputs of the operators, derived in Spark from the given tables (recipes in FIXTURES.md).

``checks/tables.py`` states the same recipes in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.functions import features, parsing
from alertloom.runtime import spread
from alertloom.sources.rules import rules_from_lines

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
PORTS = (22, 80, 3306, 443)
PACKET_PORTS = (22, 80, 3306, 443, 514, 53)

RULE_LINES = (
    "# rules for the test packets",
    "",
    'alert tcp any any -> $HOME_NET 22 (msg:"Word on port 22"; flow:to_server,established; content:" THE ", nocase; '
    "detection_filter: track by_src, count 5, seconds 259200; sid:1000002; rev:1;)",
    'alert tcp any any -> $HOME_NET any (msg:"FIN only"; flags: F,1; sid:1000001; rev:1;)',
    'alert icmp any any -> $HOME_NET any (msg:"Ping"; itype:8; icode:0; detection_filter: track by_src, count 2, '
    "seconds 43200; sid:1000004; rev:1;)",
    'alert udp any any -> $HOME_NET 3306 (content:" the "; content:" of "; msg:"Two words"; '
    'metadata: former_category "Test set"; sid:1000005; rev:2;)',
    'alert tcp any any -> $HOME_NET 80 (content:".\\n"; msg:"Line end"; sid:1000006; rev:1;)',
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row."""
    return spread(table(spark, sf, name), key)


def pick(index: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def i() -> Column:
    return F.col("event_id")


def source_ip() -> Column:
    user = F.col("user_id")
    return F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))


def type_number() -> Column:
    kinds = ("click", "error", "purchase", "signup", "view")
    out = F.lit(None).cast("long")
    for n, kind in enumerate(kinds, 1):
        out = F.when(F.col("event_type") == kind, F.lit(n).cast("long")).otherwise(out)
    return out


def true_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert per event, with every field known, before it is written as a line."""
    icmp = i() % 7 == 0
    stamp = F.date_format("ts", ISO)
    return spread_table(spark, sf, "events", "event_id").select(
        i().alias("pos"),
        F.concat(F.lit("log"), (i() % 3).cast("string")).alias("file"),
        F.when(i() % 2 == 0, F.concat(stamp, F.lit("-06:00"))).otherwise(F.date_format("ts", "MM/dd-HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.concat(F.lit("1:"), (1000000 + type_number()).cast("string"), F.lit(":1")).alias("signature_id"),
        F.col("event_type").alias("message"),
        F.when(icmp, "ICMP").otherwise("TCP").alias("protocol"),
        source_ip().alias("source_ip"),
        F.when(~icmp, 1024 + i() % 60000).cast("string").alias("source_port"),
        F.lit("192.168.1.44").alias("dest_ip"),
        F.when(~icmp, pick(i() % 4, PORTS)).cast("string").alias("dest_port"),
    )


def alert_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(value, file, pos): syslog lines, fast lines and noise."""
    t = true_alerts(spark, sf)
    c = {n: F.col(n) for n in parsing.FIELDS}
    syslog = parsing.format_alert(c["timestamp"], F.lit("kali"), *[c[n] for n in parsing.FIELDS[1:]])
    end = lambda ip, port: F.concat(c[ip], F.coalesce(F.concat(F.lit(":"), c[port]), F.lit("")))
    fast = F.concat(
        c["timestamp"], F.lit(" [**] ["), c["signature_id"], F.lit('] "'), c["message"], F.lit('" '),
        F.when(F.col("pos") % 4 == 1, "[**] ").otherwise(""),
        F.when(F.col("pos") % 3 == 0, "[Classification: x y] [Priority: 2] ").otherwise(""),
        F.lit("{"), c["protocol"], F.lit("} "), end("source_ip", "source_port"), F.lit(" -> "), end("dest_ip", "dest_port"),
    )
    noise = F.concat(F.lit("noise "), F.col("pos").cast("string"))
    value = F.when(F.col("pos") % 10 == 9, noise).when(F.col("pos") % 2 == 0, syslog).otherwise(fast)
    return t.select(value.alias("value"), "file", "pos")


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """One packet per event; the payload is the whole text of a document."""
    documents = table(spark, sf, "documents")
    n = documents.count()
    e = spread_table(spark, sf, "events", "event_id").withColumn("doc_id", i() % n)
    joined = e.join(documents.select("doc_id", "text"), "doc_id", "left")
    proto = F.when(i() % 5 <= 2, "tcp").when(i() % 5 == 3, "udp").otherwise("icmp")
    icmp = i() % 5 == 4
    body = F.encode("text", "UTF-8")
    payload = (
        F.when(i() % 11 == 0, F.encode(F.lit(""), "UTF-8"))
        .when(i() % 13 == 0, F.encode(F.lit("GET "), "UTF-8"))
        .when(i() % 17 == 0, F.concat(F.unhex(F.lit("FF")), body))
        .otherwise(body)
    )
    local = F.concat(F.lit("192.168.1."), F.col("user_id").cast("string"))
    return joined.select(
        i().alias("packet_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        proto.alias("protocol"),
        F.when(F.col("user_id") < 60, local).otherwise(source_ip()).alias("src_ip"),
        (1024 + i() % 60000).cast("int").alias("src_port"),
        F.when(i() % 9 == 8, "203.0.113.7").otherwise("192.168.1.44").alias("dst_ip"),
        F.when(~icmp, pick(i() % 6, PACKET_PORTS)).cast("int").alias("dst_port"),
        payload.alias("payload"),
        F.when(~icmp, F.when(i() % 8 == 0, "F").when(i() % 8 == 1, "S").otherwise("PA")).alias("tcp_flags"),
        F.when(icmp, 8).cast("int").alias("itype"),
        F.when(icmp, 0).cast("int").alias("icode"),
        (i() % 3 != 0).alias("to_server"),
        (i() % 4 != 0).alias("established"),
    )


def rules(spark: SparkSession) -> DataFrame:
    return rules_from_lines(spark.createDataFrame([(r,) for r in RULE_LINES], "value string"))


def suppressions(spark: SparkSession) -> DataFrame:
    rows = [(1, 1000002, None, None), (1, 1000004, "by_src", "10.0.0.7"), (None, None, "by_src", "10.0.0.9"), (1, 1000001, "by_dst", "192.168.1.45")]
    return spark.createDataFrame(rows, "gid int, sid long, track string, ip string")


def labelled(spark: SparkSession, sf: str, label: str = "toxic") -> DataFrame:
    """Documents with a label; the port is the document number modulo 1024."""
    joined = spread_table(spark, sf, "documents", "doc_id").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("message"), (F.col("doc_id") % 1024).alias("dest_port"),
        F.col(label).alias("label"),
    )


def page_messages(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "pages", "page_id").select("page_id", F.col("html").alias("message"), (F.col("page_id") % 1024).alias("dest_port"))


def page_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.engineer_features(page_messages(spark, sf), keep=("page_id",))


def port_texts() -> Column:
    """A port as it may be spelled in a file."""
    n = F.col("event_id").cast("string")
    spelled = (
        n, F.concat(n, F.lit(".7")), F.concat(F.lit("0x"), n), F.lit("-"), F.concat(F.lit(" "), n, F.lit(" ")),
        F.concat(n, F.lit("e3")), F.lit(""), F.lit(None).cast("string"), F.concat(n, F.lit("d")),
        F.concat(F.lit("+"), n), F.concat(F.lit("."), n), F.concat(F.lit("-"), n), F.lit("inf"),
        F.concat(F.lit("9"), n, F.lit("e300")), F.concat(n, F.lit(".")), F.lit("1e400"),
    )
    out = spelled[-1]
    for k in range(len(spelled) - 1):
        out = F.when(F.col("event_id") % len(spelled) == k, spelled[k]).otherwise(out)
    return out


def raw_labels() -> Column:
    """A label as it may be spelled in a file."""
    kinds = ("BENIGN", " Normal ", "0", "DDoS", "1", "1.0", "10", None, "Bot-", "benign traffic")
    out = F.lit(None).cast("string")
    for k, text in enumerate(kinds):
        value = F.lit(text).cast("string")
        if text == "Bot-":
            value = F.concat(value, F.col("event_type"))
        out = F.when(F.col("event_id") % len(kinds) == k, value).otherwise(out)
    return out


def mined_messages() -> Column:
    """Alert messages with and without payload marks, some of them uninformative."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    return (
        F.when(i() % 6 == 0, F.concat(kind, F.lit(" payload=p"), n, F.lit(" rest")))
        .when(i() % 6 == 1, F.concat(kind, F.lit(" payload=a"), n, F.lit("payload=b c")))
        .when(i() % 6 == 2, F.concat(F.lit("Generic "), kind))
        .when(i() % 6 == 3, F.concat(F.lit("unknown "), kind))
        .when(i() % 6 == 4, F.concat(F.lit("Unknown "), kind))
        .otherwise(kind)
    )


def packet_responses() -> Column:
    """Answers to a packet prompt, good and bad, one shape per ``event_id % 8``."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    rule = lambda tail: F.concat(F.lit('alert tcp any any -> $HOME_NET 80 (msg:"'), kind, F.lit(f'"; content:"'), n, F.lit('"'), F.lit(tail))
    shapes = (
        rule("; sid:5; rev:1;)"),
        F.concat(F.lit("Here is the rule: "), rule("; sid: 77; rev:1;)")),
        F.replace(rule("; sid:5;\n rev:1;)"), F.lit("; "), F.lit(";\n")),
        rule(")"),
        rule('; content:"odd; sid:5; rev:1;)'),
        F.concat(F.lit("I cannot write a rule for "), n),
        rule("; rev:1;)"),
        rule('; content:"database(), user()"; sid:5; rev:1;)\r\n```\nIt looks for a call (see above) in the text'),
    )
    out = shapes[-1]
    for k in range(len(shapes) - 1):
        out = F.when(i() % len(shapes) == k, shapes[k]).otherwise(out)
    return out


def mined_responses(kind: Column, n: Column) -> Column:
    """Answers to a mining prompt, one shape per ``n % 5``."""
    text = n.cast("string")
    rule = lambda tail: F.concat(F.lit('alert tcp $EXTERNAL_NET any -> $HOME_NET 80 (msg:"AI-MINED '), kind, F.lit('"; content:"'), text, F.lit(f'"{tail}'))
    shapes = (
        rule("; sid:1000020; rev:1;)"),
        F.concat(F.lit("```snort\n"), rule("; sid: 9; rev:3;)"), F.lit("\n```")),
        rule("; src ip 10.0.0.1 Dst Port 80   flow:to_server;)"),
        F.concat(F.lit("Sure, "), rule("; rev:1;)")),
        rule('; content:"user()"; sid:1; rev:1;)'),
    )
    out = shapes[-1]
    for k in range(len(shapes) - 1):
        out = F.when(n % len(shapes) == k, shapes[k]).otherwise(out)
    return out


def suggestion_bodies() -> Column:
    """Stored suggestion blocks as they may look, one shape per ``event_id % 7``."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    rule = lambda tail: F.concat(F.lit('tcp any any -> $HOME_NET 80 (msg:"'), kind, F.lit('"; content:"'), n, F.lit(f'"{tail}'))
    shapes = (
        F.concat(F.lit("alert "), rule("; sid:5; rev:1;)")),
        F.concat(F.lit("bash\nalert "), rule(";\n  sid:5; rev:1;)")),
        F.concat(F.lit("```\ndrop "), rule("; sid:5; rev:1;)\n```\nThis rule looks for calls.")),
        F.concat(F.lit("alert "), rule('; content:"f();x"; sid:5; rev:1;)')),
        F.concat(F.lit("nothing useful here "), n),
        F.lit(""),
        F.concat(F.lit("reject "), rule("; sid:5; rev:1)")),
    )
    out = shapes[-1]
    for k in range(len(shapes) - 1):
        out = F.when(i() % len(shapes) == k, shapes[k]).otherwise(out)
    return out
