"""Prompts, rule cleaning and numbering, suggestion and rule stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import rule_text
from alertloom.operators import dedup, filters, joins, numbering
from alertloom.plans import jobs
from alertloom.runtime import scratch_path, settle
from alertloom.sources import rules, suggestions
from alertloom.sources.alerts import CSV_OPTIONS, read_alerts_for_mining
from checks import inputs
from checks.registry import query
from checks.tables import sql


def events(spark, sf):
    return inputs.spread_table(spark, sf, "events", "event_id")


@query("P16_payload_hint", sql("SELECT event_id, hint FROM hinted", "mined_messages", "hinted"))
def p16(spark, sf):
    return events(spark, sf).select("event_id", rule_text.payload_hint(inputs.mined_messages()).alias("hint"))


@query("F9_informative", sql("SELECT event_id, message FROM mined_messages WHERE message NOT LIKE '%Generic%' AND message NOT LIKE '%Unknown%'", "mined_messages"))
def f9(spark, sf):
    return filters.informative(events(spark, sf).select("event_id", inputs.mined_messages().alias("message")))


def quoted(template: str, *slots: str) -> str:
    """A prompt template as a SQL text expression."""
    text = "'" + template.replace("'", "''") + "'"
    for k, slot in enumerate(slots):
        text = f"replace({text}, '{{{k}}}', {slot})"
    return text


PROMPT = quoted(rule_text.MINING_PROMPT, "message", "(event_id % 1024)::VARCHAR", "hint")


@query("P17_mining_prompt", sql(f"SELECT event_id, md5({PROMPT}) AS digest FROM hinted", "mined_messages", "hinted"))
def p17(spark, sf):
    message = inputs.mined_messages()
    prompt = rule_text.mining_prompt(message, F.col("event_id") % 1024, rule_text.payload_hint(message))
    return events(spark, sf).select("event_id", F.md5(prompt).alias("digest"))


SHOWN = r"""replace(replace(substr(text, 1, 100), '"', '\"'), chr(10), ' ')"""


@query(
    "P18_packet_prompt",
    sql(f"SELECT packet_id, md5({quoted(rule_text.PACKET_PROMPT, 'protocol', 'dst_port::VARCHAR', SHOWN)}) AS digest FROM inspected", "packets", "outside", "inspected"),
)
def p18(spark, sf):
    kept = filters.inspectable(inputs.packets(spark, sf))
    prompt = rule_text.packet_prompt(F.col("protocol"), F.col("dst_port"), F.col("message"))
    return kept.select("packet_id", F.md5(prompt).alias("digest"))


RULES = ("packet_rules", "clean_packet_rules")


@query("P19_sanitise_packet_rule", sql("SELECT event_id, rule, reject_reason FROM clean_packet_rules", *RULES))
def p19(spark, sf):
    cleaned = events(spark, sf).select("event_id", rule_text.sanitise_packet_rule(inputs.packet_responses()).alias("r"))
    return cleaned.select("event_id", "r.*")


NUMBERED = r"""SELECT event_id, sid, CASE WHEN contains(rule, 'sid:') THEN regexp_replace(rule, 'sid:\s*[0-9]+;', 'sid:' || sid || ';', 'g')
    ELSE regexp_replace(rule, ';\)$', '; sid:' || sid || '; rev:1;)') END AS rule
    FROM (SELECT *, 2000000 - 1 + dense_rank() OVER (ORDER BY md5(rule)) AS sid FROM clean_packet_rules WHERE rule IS NOT NULL)"""


@query("P20_assign_sid", sql(NUMBERED, *RULES))
def p20(spark, sf):
    cleaned = fresh_rules(spark, sf)
    numbered = numbering.number_texts(cleaned, "rule", 2000000, "sid")
    return numbered.select("event_id", "sid", rule_text.with_sid(F.col("rule"), F.col("sid")).alias("rule"))


def mined_shapes(kind: str, n: str) -> str:
    """The cleaned form of each mined response, before numbering."""
    head = f"""'alert tcp $EXTERNAL_NET any -> $HOME_NET 80 (msg:"AI-MINED ' || {kind} || '"; content:"' || {n} || '"'"""
    return f"""CASE {n} % 5 WHEN 0 THEN {head} || '; sid:1000020; rev:1;)' WHEN 1 THEN {head} || '; sid: 9; rev:3;)'
      WHEN 2 THEN {head} || '; flow:to_server;)' WHEN 3 THEN 'Sure, ' || {head} || '; rev:1;)'
      ELSE {head} || '; content:"user()"; sid:1; rev:1;)' END"""


MINED = f"SELECT event_id, event_type, {mined_shapes('event_type', 'event_id')} AS rule FROM events"


@query("P21_sanitise_mined_rule", MINED.replace("event_type, CASE", "CASE"))
def p21(spark, sf):
    response = inputs.mined_responses(F.col("event_type"), F.col("event_id"))
    return events(spark, sf).select("event_id", rule_text.sanitise_mined_rule(response).alias("rule"))


def numbered_mined(source: str, order: str, start: int) -> str:
    return rf"""SELECT {order}, sid, regexp_replace(regexp_replace(regexp_replace(rule, 'sid:\s*[0-9]+;', '', 'g'), 'rev:\s*[0-9]+;', '', 'g'),
      '[; ]*\)$', '; sid:' || sid || '; rev:1;)') AS rule
      FROM (SELECT *, {start - 1} + row_number() OVER (ORDER BY {order}) AS sid FROM ({source}) WHERE rule LIKE 'alert%')"""


@query("P22_assign_mined_sid", numbered_mined(MINED, "event_id", 1000100))
def p22(spark, sf):
    response = inputs.mined_responses(F.col("event_type"), F.col("event_id"))
    cleaned = events(spark, sf).select("event_id", rule_text.sanitise_mined_rule(response).alias("rule"))
    valid = cleaned.where(rule_text.is_mined_rule(F.col("rule")))
    numbered = numbering.number_rows(valid, ["event_id"], 1000100, "sid")
    return numbered.select("event_id", "sid", rule_text.with_mined_sid(F.col("rule"), F.col("sid")).alias("rule"))


@query(
    "P22_every_parenthesis",
    rf"""SELECT event_id, replace(regexp_replace(rule, 'sid:\s*[0-9]+;', '', 'g'), ')', '; sid:' || event_id || '; rev:1;)') AS rule FROM ({MINED})""",
)
def p22_reference(spark, sf):
    response = inputs.mined_responses(F.col("event_type"), F.col("event_id"))
    rule = rule_text.with_mined_sid(rule_text.sanitise_mined_rule(response), F.col("event_id"), "reference")
    return events(spark, sf).select("event_id", rule.alias("rule"))


HEADS = ("suggestion_heads", "clean_suggestions")


@query("P23_sanitise_suggestion", sql("SELECT event_id, rule FROM clean_suggestions WHERE rule IS NOT NULL", *HEADS))
def p23(spark, sf):
    cleaned = events(spark, sf).select("event_id", rule_text.sanitise_suggestion(inputs.suggestion_bodies()).alias("rule"))
    return cleaned.where("rule IS NOT NULL")


@query(
    "P23_reference_cut",
    sql(
        """SELECT event_id, CASE WHEN contains(rule, ');') THEN regexp_replace(rule, '\\);[^)]*\\)$', ');') ELSE rule END AS rule
        FROM (SELECT event_id, CASE event_id % 7 WHEN 2 THEN rule || ' ``` This rule looks for calls.' ELSE rule END AS rule FROM clean_suggestions)
        WHERE rule IS NOT NULL""".replace("\\\\", "\\"),
        *HEADS,
    ),
)
def p23_reference(spark, sf):
    cleaned = events(spark, sf).select("event_id", rule_text.sanitise_suggestion(inputs.suggestion_bodies(), "reference").alias("rule"))
    return cleaned.where("rule IS NOT NULL")


BARE = r"""regexp_replace(regexp_replace(rule, '\s*(sid|rev):\s*[0-9]+;', '', 'g'), ';[\s;]*;', ';', 'g')"""


@query(
    "D3_drop_known_rules",
    sql(
        f"""SELECT event_id, rule FROM (SELECT *, {BARE} AS k FROM clean_packet_rules WHERE rule IS NOT NULL)
        WHERE k NOT IN (SELECT {BARE} FROM clean_packet_rules WHERE rule IS NOT NULL AND event_id % 3 = 0)""",
        *RULES,
    ),
)
def d3(spark, sf):
    """Every third rule is stored, under another number."""
    cleaned = fresh_rules(spark, sf)
    new = cleaned.withColumn("rule_key", rule_text.without_identity(F.col("rule")))
    stored = cleaned.where("event_id % 3 = 0").select(rule_text.with_sid(F.col("rule"), F.col("event_id")).alias("rule"))
    return dedup.drop_known_rules(new, stored.select(rule_text.without_identity(F.col("rule")).alias("rule_key"))).select("event_id", "rule")


def decisions(spark, sf):
    return events(spark, sf).where("event_id % 5 <> 4").select(
        F.col("event_id").alias("suggestion_id"), F.when(F.col("event_id") % 5 < 2, "y").otherwise("n").alias("decision")
    )


@query("J3_apply_decisions", "SELECT event_id AS suggestion_id, event_type FROM events WHERE event_id % 5 < 2")
def j3(spark, sf):
    return joins.apply_decisions(events(spark, sf).select(F.col("event_id").alias("suggestion_id"), "event_type"), decisions(spark, sf))


@query("J3_undecided", "SELECT event_id AS suggestion_id, event_type FROM events WHERE event_id % 5 = 4")
def j3_undecided(spark, sf):
    return joins.undecided(events(spark, sf).select(F.col("event_id").alias("suggestion_id"), "event_type"), decisions(spark, sf))


def fresh_rules(spark, sf):
    rule = rule_text.sanitise_packet_rule(inputs.packet_responses())["rule"]
    return events(spark, sf).select("event_id", rule.alias("rule")).where("rule IS NOT NULL")


@query(
    "S7_write_suggestions",
    sql(f"SELECT DISTINCT {BARE} AS rule_key FROM clean_packet_rules WHERE rule IS NOT NULL", *RULES),
)
def s7(spark, sf):
    """Written in two overlapping batches; the store holds each rule once."""
    store = scratch_path(spark, "suggestions")
    suggestions.write_suggestions(fresh_rules(spark, sf).where("event_id % 3 < 2"), store)
    suggestions.write_suggestions(fresh_rules(spark, sf), store)
    return suggestions.stored_rules(spark, store).select("rule_key")


BODIES = """SELECT CASE shape WHEN 0 THEN 'alert ' || head || '; sid:5; rev:1;)' WHEN 1 THEN 'bash' || chr(10) || 'alert ' || head || ';' || chr(10) || '  sid:5; rev:1;)'
    WHEN 2 THEN '```' || chr(10) || 'drop ' || head || '; sid:5; rev:1;)' || chr(10) || '```' || chr(10) || 'This rule looks for calls.'
    WHEN 3 THEN 'alert ' || head || '; content:"f();x"; sid:5; rev:1;)' WHEN 4 THEN 'nothing useful here ' || event_id
    WHEN 6 THEN 'reject ' || head || '; sid:5; rev:1)' END AS body FROM suggestion_heads WHERE shape <> 5"""


def stored_blocks(spark, sf):
    path = scratch_path(spark, "blocks")
    suggestions.export_suggestions(events(spark, sf).select(inputs.suggestion_bodies().alias("rule")), path)
    return path


@query("S8_read_suggestions", sql(BODIES, "suggestion_heads"))
def s8(spark, sf):
    return suggestions.read_suggestions(spark, stored_blocks(spark, sf)).select("body")


@query(
    "S9_write_mined_rules",
    f"""WITH n AS ({numbered_mined(MINED, "event_id", 1000100)}),
    t AS (SELECT '# Based on log: ' || event_type || chr(10) || rule || chr(10) AS v FROM n JOIN events USING (event_id)
      UNION ALL SELECT '# AI-Mined Snort Rules' || chr(10) || '# Generated from events analysis' || chr(10)
        || '# These rules use $HOME_NET and $EXTERNAL_NET variables.' || chr(10))
    SELECT value, count(*) AS n FROM (SELECT unnest(string_split(v, chr(10))) AS value FROM t) GROUP BY value""",
)
def s9(spark, sf):
    response = inputs.mined_responses(F.col("event_type"), F.col("event_id"))
    cleaned = events(spark, sf).select("event_id", F.col("event_type").alias("message"), rule_text.sanitise_mined_rule(response).alias("rule"))
    valid = cleaned.where(rule_text.is_mined_rule(F.col("rule")))
    numbered = numbering.number_rows(valid, ["event_id"], 1000100, "sid")
    path = scratch_path(spark, "mined")
    suggestions.write_mined_rules(numbered.withColumn("rule", rule_text.with_mined_sid(F.col("rule"), F.col("sid"))), path, "events")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


APPENDED = """WITH r AS (SELECT DISTINCT event_id % 100 AS k FROM events),
    t AS (SELECT k, format('alert tcp any any -> any 80 (msg:"m{}";', k) AS head, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 10 END AS sid FROM r),
    a AS (SELECT *, md5(head || ' rev:1;)') AS digest, sid IS NOT NULL AND head = min(head) OVER (PARTITION BY sid) AS own FROM t WHERE k < 60),
    first AS (SELECT head, CASE WHEN own THEN sid ELSE 9 + row_number() OVER (PARTITION BY own ORDER BY md5(head || ')')) END AS sid FROM a),
    more AS (SELECT head, (SELECT max(sid) FROM first) + row_number() OVER (ORDER BY md5(head || ')')) AS sid FROM t WHERE k >= 60)
    SELECT sid, format('{} sid:{}; rev:1;)', head, sid) AS rule FROM (FROM first UNION ALL FROM more)"""


@query("S12_append_rules", APPENDED)
def s12(spark, sf):
    """Rules share numbers or lack one, and come twice."""
    store = scratch_path(spark, "rules")
    k = F.col("event_id") % 100
    head = F.concat(F.lit('alert tcp any any -> any 80 (msg:"m'), k.cast("string"), F.lit('";'))
    sid = F.when(k % 7 != 0, k % 10)
    rule = F.concat(head, F.coalesce(F.concat(F.lit(" sid:"), sid.cast("string"), F.lit("; rev:1;)")), F.lit(")")))
    approved = events(spark, sf).select(k.alias("k"), sid.alias("sid"), rule.alias("rule"))
    rules.append_rules(approved.where("k < 60"), store)
    rules.append_rules(approved, store)
    return spark.read.parquet(store)


def mining_alerts(spark, sf):
    """An alert table as files whose order is that of the events."""
    path = scratch_path(spark, "alerts")
    rows = events(spark, sf).select(
        "event_id", inputs.mined_messages().alias("Message"), (F.col("event_id") % 4).cast("string").alias(" dest_port"),
        F.when(F.col("event_id") % 9 == 0, 0).otherwise(1).alias("label"),
    )
    rows.orderBy("event_id").drop("event_id").write.options(**CSV_OPTIONS).csv(path)
    return read_alerts_for_mining(spark, path)


ATTACKS = """SELECT message, event_id % 4 AS port, min(event_id) AS prompt_id, length(message) AS n FROM mined_messages
    WHERE event_id % 9 <> 0 AND message NOT LIKE '%Generic%' AND message NOT LIKE '%Unknown%' GROUP BY ALL"""


@query(
    "C3_mining_job",
    sql(
        "", "mined_messages"
    ).rstrip() + f""", a AS ({ATTACKS}), n AS ({numbered_mined(f"SELECT prompt_id, {mined_shapes('message', 'n')} AS rule FROM a", "prompt_id", 1000100)}),
    t AS (SELECT '# Based on log: ' || message || chr(10) || rule || chr(10) AS v FROM n JOIN a USING (prompt_id)
      UNION ALL SELECT '# AI-Mined Snort Rules' || chr(10) || '# Generated from alerts analysis' || chr(10)
        || '# These rules use $HOME_NET and $EXTERNAL_NET variables.' || chr(10))
    SELECT value, count(*) AS n FROM (SELECT unnest(string_split(v, chr(10))) AS value FROM t) GROUP BY value""",
)
def c3(spark, sf):
    """From an alert table to a rules file."""
    prompts = settle(jobs.mining_prompts(mining_alerts(spark, sf)), "prompts")
    answers = prompts.select("prompt_id", inputs.mined_responses(F.col("message"), F.length("message")).alias("response"))
    path = scratch_path(spark, "mined")
    jobs.mining_job(prompts, answers, path=path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C5_approval_job",
    sql(
        "", *HEADS
    ).rstrip() + rf""", a AS (SELECT {BARE} AS k, min(rule) AS rule FROM clean_suggestions WHERE rule IS NOT NULL AND event_id % 5 < 2 GROUP BY 1),
    n AS (SELECT rule, CASE WHEN k = (SELECT min(k) FROM a) THEN 5 ELSE 5 + row_number() OVER (PARTITION BY k = (SELECT min(k) FROM a) ORDER BY md5(k)) END AS sid FROM a)
    SELECT sid, regexp_replace(rule, 'sid:\s*[0-9]+;', 'sid:' || sid || ';') AS rule FROM n""",
)
def c5(spark, sf):
    """From a suggestions file to the rule store; all suggestions bear the same number."""
    blocks = jobs.stored_suggestions(spark, stored_blocks(spark, sf))
    body = F.trim(inputs.suggestion_bodies(), F.lit(" \t\n\r\x0b\x0c"))
    said = events(spark, sf).where("event_id % 5 <> 4").select(F.md5(body).alias("suggestion_id"), F.when(F.col("event_id") % 5 < 2, "y").otherwise("n").alias("decision"))
    store = scratch_path(spark, "rules")
    jobs.approval_job(blocks, said, store)
    return spark.read.parquet(store)
