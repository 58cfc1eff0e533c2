"""The live jobs, run over files written from the tables until all have been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import parsing, rule_text
from alertloom.operators import joins
from alertloom.runtime import scratch_path
from alertloom.sources.packets import stream_packets
from alertloom.sources.suggestions import stored_rules
from alertloom.streaming import jobs
from alertloom.streaming.stateful import StateThreshold
from checks import inputs, model_queries
from checks.alert_queries import ARRIVED, EIGHT, EXPECTED, PIECES, VERDICTS, expected_rules, written_lines
from checks.registry import query
from checks.rule_queries import BARE, fresh_rules
from checks.tables import KIND, SOURCE, sql


def finish(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception():
        raise stream_query.exception()


def log_folder(spark, sf):
    return written_lines(spark, sf)[0].rsplit("/", 1)[0]


@query("T1_stream_alerts", sql(f"SELECT {EIGHT} FROM alerts", "alerts"))
def t1(spark, sf):
    out = scratch_path(spark, "streamed")
    alerts = jobs.stream_alerts(spark, log_folder(spark, sf) + "/*", files_per_batch=8)
    finish(jobs.run_available(alerts, out, scratch_path(spark, "progress")))
    return spark.read.parquet(out).select(*parsing.FIELDS)


@query("T2_stream_score", model_queries._attacks())
def t2(spark, sf):
    model = model_queries.planted_detector(spark, sf)
    path, out = scratch_path(spark, "packets"), scratch_path(spark, "scored")
    model_queries.planted_packets(spark, sf).write.parquet(path)
    finish(jobs.run_available(jobs.stream_score(model, stream_packets(spark, path, 8)), out, scratch_path(spark, "progress")))
    return model_queries.shown(spark.read.parquet(out))


def in_time_order(spark, sf):
    """Events as files that follow each other in time."""
    path = scratch_path(spark, "matches")
    rows = inputs.table(spark, sf, "events").select(
        F.col("event_id").alias("packet_id"), F.col("ts").cast("timestamp").alias("ts"), inputs.type_number().alias("sid"), inputs.source_ip().alias("src_ip"),
    )
    # Early, middle and late, without a remainder.
    early, late = F.col("ts") < "2024-01-11", F.col("ts") >= "2024-01-21"
    for part in (early, ~early & ~late, late):
        rows.where(part).repartition(1).write.mode("append").parquet(path)
    return path, rows.schema


OVER_THRESHOLD = f"""WITH a AS (SELECT event_id AS packet_id, ts, {KIND} AS sid, {SOURCE} AS src_ip FROM events)
    SELECT packet_id, sid, src_ip FROM (SELECT *, count(*) OVER (PARTITION BY sid, src_ip ORDER BY epoch_us(ts)
    RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS n FROM a) WHERE n >= 2"""


@query("T3_stream_detection_filter", OVER_THRESHOLD)
def t3(spark, sf):
    path, schema = in_time_order(spark, sf)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    threshold = jobs.ThresholdStream(scratch_path(spark, "threshold"), "src_ip", 2, 43200)
    finish(threshold.start(stream, scratch_path(spark, "progress")))
    threshold.flush(spark)
    return threshold.passed(spark).select("packet_id", "sid", "src_ip")


@query("T3_threshold_in_state", OVER_THRESHOLD)
def t3_state(spark, sf):
    """The same threshold in Spark's state store; a last row without a rule ends the spans that are still open."""
    path, schema = in_time_order(spark, sf)
    stored = spark.read.schema(schema).parquet(path)
    last = stored.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    threshold = StateThreshold(scratch_path(spark, "verdicts"), "src_ip", 2, 43200)
    finish(threshold.start(stream, scratch_path(spark, "progress")))
    return threshold.passed(stored.where("sid is not null")).select("packet_id", "sid", "src_ip")


@query(
    "T4_stream_suggest",
    sql(f"SELECT DISTINCT {BARE} AS rule_key FROM clean_packet_rules WHERE rule IS NOT NULL", "packet_rules", "clean_packet_rules"),
)
def t4(spark, sf):
    path, store = scratch_path(spark, "rules"), scratch_path(spark, "suggestions")
    rules = fresh_rules(spark, sf)
    rules.unionByName(rules.select("event_id", rule_text.with_sid(F.col("rule"), F.col("event_id")).alias("rule"))).repartition(4).write.parquet(path)
    stream = spark.readStream.schema("event_id long, rule string").option("maxFilesPerTrigger", 2).parquet(path)
    finish(jobs.stream_suggest(stream, store, scratch_path(spark, "progress")))
    return stored_rules(spark, store).select("rule_key")


def verified(spark, sf):
    """The lines come with their place, out of order over several batches."""
    path = scratch_path(spark, "lines")
    written = inputs.alert_lines(spark, sf)
    written.repartition(16, "pos").write.parquet(path)
    lines = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", 3).parquet(path)
    stream = jobs.VerifyStream(expected_rules(spark, sf), scratch_path(spark, "verdicts"), 2024, pos="pos")
    finish(stream.start(lines, scratch_path(spark, "progress")))
    return stream


@query("T5_stream_verify", sql("", "lines", "alerts").rstrip() + f", {EXPECTED}, {ARRIVED} {VERDICTS}")
def t5(spark, sf):
    found = verified(spark, sf).verdicts()
    return found.select("sid", F.unix_seconds("since").alias("since_s"), F.col("wait_seconds").cast("long"), "passed", "first_line")


@query(
    "T5_lines_of_failed_rules",
    sql("", "lines", "alerts").rstrip() + f""", {PIECES}
    SELECT f.sid, f.since_s, a.pos FROM failed f JOIN arrived a ON since_s * 1000000 < epoch_us(event_ts) AND until_s * 1000000 >= epoch_us(event_ts)""",
)
def t5_failed(spark, sf):
    """When the stream has ended, rules that did not fire, with what arrived in their windows instead."""
    lines, ranges = verified(spark, sf).failures(ended=True)
    return joins.expand_lines(lines, ranges).select(F.col("expected_sid").alias("sid"), F.unix_seconds("since").alias("since_s"), F.col("_order").alias("pos"))
