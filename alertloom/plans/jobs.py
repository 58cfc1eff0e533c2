"""The composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.functions import features, rule_text
from alertloom.models.detector import Detector, score_packets
from alertloom.models.training import train_detector
from alertloom.operators import alerts as A, dedup, filters, joins, numbering, reports, sampling, thresholds
from alertloom.operators.union import union_datasets
from alertloom.runtime import require_rows, settle
from alertloom.sources.rules import append_rules
from alertloom.sources.suggestions import new_suggestions, read_suggestions, write_mined_rules, write_suggestions


def alerts_job(lines: DataFrame, suppressions: DataFrame, year: int, zone: str = "+00:00") -> DataFrame:
    """Alert lines to the summary of what remains after suppression."""
    typed = A.typed_alerts(A.parse_alerts(lines), year, zone)
    return A.alert_summary(joins.suppress(typed, suppressions))


def detection_job(packets: DataFrame, rules: DataFrame, suppressions: DataFrame, variables: dict | None = None) -> DataFrame:
    """Packets to alerts: rule match, per-rule thresholds, suppression.

    The payload is dropped right after the match, so no later shuffle carries it.
    Matches are written once, because the thresholds read them twice.
    """
    matched = joins.match_rules(packets, rules, variables).drop("payload")
    alerts = thresholds.detection_filters(settle(matched, "matches")).withColumn("gid", F.lit(1).cast("long"))
    return joins.suppress(alerts, suppressions, source="src_ip", dest="dst_ip")


def verified_detection(
    packets: DataFrame, rules: DataFrame, suppressions: DataFrame, expected: DataFrame, variables: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """(alerts, verdicts): the detection job, and whether each expected rule (sid, since, wait_seconds) raised an alert in its window.

    The first line of a verdict is the message of the alert with the lowest packet number.
    """
    alerts = settle(detection_job(packets, rules, suppressions, variables), "detected")
    seen = alerts.select("sid", F.col("ts").alias("event_ts"), F.col("msg").alias("line"), F.col("packet_id").alias("pos"))
    return alerts, joins.verify_rules(expected, seen)


def mining_prompts(alerts: DataFrame, order: str = "pos") -> DataFrame:
    """One prompt per distinct, informative attack; ``prompt_id`` is the place of its first alert."""
    attacks = filters.informative(dedup.distinct_attacks(filters.malicious(alerts), order))
    hint = rule_text.payload_hint(F.col("message"))
    return attacks.select(
        F.col(order).alias("prompt_id"), "message", "dest_port",
        rule_text.mining_prompt(F.col("message"), F.col("dest_port"), hint).alias("prompt"),
    )


def mining_job(prompts: DataFrame, responses: DataFrame, first_sid: int = 1000100, path: str | None = None, source: str = "alerts") -> DataFrame:
    """Answers to the mining prompts, cleaned and numbered in the order of the prompts.

    ``responses`` is (prompt_id, response). Only valid rules take a number. With ``path``
    the rules are written there as a rules file that names its ``source``.
    """
    answered = prompts.select("prompt_id", "message").join(responses, "prompt_id")
    cleaned = answered.select("prompt_id", "message", rule_text.sanitise_mined_rule(F.col("response")).alias("rule"))
    valid = cleaned.where(rule_text.is_mined_rule(F.col("rule")))
    numbered = numbering.number_rows(valid, ["prompt_id"], first_sid, "sid")
    rules = numbered.withColumn("rule", rule_text.with_mined_sid(F.col("rule"), F.col("sid")))
    if path is not None:
        rules = settle(rules, "mined")
        write_mined_rules(rules, path, source)
    return rules


def packet_suggestions(responses: DataFrame, first_sid: int, known: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Answers to packet prompts as numbered rules that are not known yet.

    Rules that differ in number only are one rule, so it gets one number however
    many packets led to it. ``known`` is (rule_key, …). With ``store`` the rules of that
    suggestion store are known too, and the new ones are appended to it.
    """
    cleaned = responses.select(rule_text.sanitise_packet_rule(F.col("response"))["rule"].alias("rule")).where("rule IS NOT NULL")
    keyed = cleaned.groupBy(rule_text.without_identity(F.col("rule")).alias("rule_key")).agg(F.min("rule").alias("rule"))
    fresh = dedup.drop_known_rules(keyed, known) if known is not None else keyed
    fresh = new_suggestions(fresh, store) if store is not None else fresh
    numbered = numbering.number_texts(settle(fresh, "suggested"), "rule_key", first_sid, "sid")
    rules = numbered.withColumn("rule", rule_text.with_sid(F.col("rule"), F.col("sid")))
    if store is not None:
        rules = settle(rules, "numbered")
        write_suggestions(rules, store)
    return rules


def stored_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """Suggestion blocks of a text file for :func:`approval_job`: suggestion_id, the digest of the block, and body.

    A block that stands twice is one suggestion.
    """
    return read_suggestions(spark, path).select(F.md5("body").alias("suggestion_id"), "body").distinct()


def approval_job(suggestions: DataFrame, decisions: DataFrame, store: str | None = None) -> DataFrame:
    """Stored suggestions, cleaned, that a person approved: (suggestion_id, rule, sid).

    With ``store`` the approved rules are appended to that rule store.
    """
    cleaned = suggestions.select("suggestion_id", rule_text.sanitise_suggestion(F.col("body")).alias("rule"))
    approved = joins.apply_decisions(cleaned.where("rule IS NOT NULL"), decisions)
    sid = F.regexp_extract("rule", r"sid:\s*(\d+);", 1).try_cast("long")
    approved = approved.withColumn("sid", sid)
    if store is not None:
        approved = settle(approved, "approved")
        append_rules(approved, store)
    return approved


def labelled_features(flows: DataFrame, label_mode: str = "reference") -> DataFrame:
    """Flow rows as feature rows."""
    named = flows.select(
        "dest_port",
        features.message_from_dataset(F.col("headerless"), F.col("attack_cat"), F.col("raw_label")).alias("message"),
        features.binarise_label(F.col("raw_label"), label_mode).alias("label"),
    )
    return features.engineer_features(named, keep=("label",))


def alert_features(alerts: DataFrame) -> DataFrame:
    """Alert rows as feature rows with label 1."""
    named = alerts.select("message", "dest_port", (F.col("label") if "label" in alerts.columns else F.lit(1)).alias("label"))
    return features.engineer_features(named, keep=("label",))


def training_job(
    datasets: dict[str, DataFrame | None], rate: float = 1.0, threshold: int = 50_000, label_mode: str = "reference",
    seed: int = 42, **options,
) -> tuple[Detector, DataFrame, DataFrame]:
    """(detector, report, class distribution) from flow data sets and, under ``alerts``, an alert table.

    With a ``rate`` below one, files of over ``threshold`` rows are sampled; by default
    every row is used. The rows become feature rows in one table, which is written because
    training reads it several times. Rows are told apart by what they hold, so samples, the
    split and both models depend on the rows and the seed and not on how files are scanned.
    The alert table (see ``read_alert_table``) joins as attacks.
    """
    parts: dict[str, DataFrame | None] = {}
    for name, df in datasets.items():
        if df is not None and name != "alerts":
            df = df if rate >= 1 else sampling.sample_large_files(df, rate, threshold, seed)
            df = labelled_features(df, label_mode)
        elif df is not None:
            df = alert_features(df)
        parts[name] = df
    rows = require_rows(settle(sampling.with_content_keys(union_datasets(parts)), "training"), "training data")
    distribution = reports.class_distribution(rows)
    detector, report = train_detector(rows, sampling.CONTENT, seed, **options)
    return detector, report, distribution


def inspection_job(
    detector: Detector, packets: DataFrame, responses: DataFrame, first_sid: int, known: DataFrame | None = None, mode: str = "either",
    store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(alerting packets with prompts, numbered new rules); ``responses`` is (prompt_id, response).

    With ``store`` the new rules are appended to that suggestion store.
    """
    alerts = settle(score_packets(detector, packets, mode), "scored")
    answered = responses.join(alerts.select(F.col("packet_id").alias("prompt_id")), "prompt_id", "left_semi")
    return alerts, packet_suggestions(answered, first_sid, known, store)
