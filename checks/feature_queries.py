"""Features, labels, data set union, samples, splits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import features
from alertloom.operators import filters, reports, sampling
from alertloom.operators.union import union_datasets
from alertloom.runtime import require_rows, scratch_path
from alertloom.sources import flows
from alertloom.sources.alerts import CSV_OPTIONS
from checks import inputs
from checks.registry import query
from checks.tables import sql

PAGES = ("page_messages", "page_features")


@query("P7_message_length", sql("SELECT page_id, message_length FROM page_features", *PAGES))
def p7(spark, sf):
    return inputs.page_messages(spark, sf).select("page_id", features.message_length(F.col("message")).alias("message_length"))


@query("P8_special_char_count", sql("SELECT page_id, special_char_count FROM page_features", *PAGES))
def p8(spark, sf):
    return inputs.page_messages(spark, sf).select("page_id", features.special_char_count(F.col("message")).alias("special_char_count"))


@query("P9_keyword_count", sql("SELECT page_id, keyword_count FROM page_features", *PAGES))
def p9(spark, sf):
    return inputs.page_messages(spark, sf).select("page_id", features.keyword_count(F.col("message")).alias("keyword_count"))


@query("P6_find_column", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type")
def p6(spark, sf):
    """The label column is found by a name that differs in case, space and underscore."""
    events = inputs.table(spark, sf, "events")
    at, _ = features.header_roles(events.columns, {"label": ["class", "Event Type", "props"]})
    found = events.columns[at["label"]]
    return events.groupBy(F.col(found).alias("label")).agg(F.count(F.lit(1)).alias("n"))


PORT = r"""CASE WHEN regexp_full_match(trim(port_text), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
    THEN coalesce(TRY_CAST(trunc(TRY_CAST(replace(trim(port_text), '+', '') AS DOUBLE)) AS BIGINT), 0) ELSE 0 END"""


@query("P10_coerce_port", sql(f"SELECT event_id, {PORT} AS port FROM port_texts", "port_texts"))
def p10(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", features.coerce_port(inputs.port_texts()).alias("port"))


@query("P11_stringify_message", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE event_type END AS message FROM events")
def p11(spark, sf):
    message = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return inputs.table(spark, sf, "events").select("event_id", features.stringify_message(message).alias("message"))


@query(
    "P12_message_from_dataset",
    sql(
        """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'Unknown Attack' ELSE event_type END
        ELSE coalesce(raw_label, 'nan') END AS message FROM raw_labels""",
        "raw_labels",
    ),
)
def p12(spark, sf):
    category = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    message = features.message_from_dataset(F.col("event_id") % 3 == 0, category, inputs.raw_labels())
    return inputs.table(spark, sf, "events").select("event_id", message.alias("message"))


LABELS = """SELECT event_id,
    CASE WHEN contains(t, 'benign') OR contains(t, 'normal') OR contains(t, '0') THEN 0 ELSE 1 END AS label,
    CASE WHEN trim(t) IN ('benign', 'normal', '0') THEN 0 ELSE 1 END AS exact_label
    FROM (SELECT event_id, lower(coalesce(raw_label, 'nan')) AS t FROM raw_labels)"""


@query("P13_binarise_label", sql(LABELS, "raw_labels"))
def p13(spark, sf):
    raw = inputs.raw_labels()
    return inputs.table(spark, sf, "events").select(
        "event_id", features.binarise_label(raw).alias("label"), features.binarise_label(raw, "exact").alias("exact_label")
    )


@query("P14_engineer_features", sql("SELECT * FROM page_features", *PAGES))
def p14(spark, sf):
    return inputs.page_features(spark, sf)


@query("F8_malicious", "SELECT doc_id, quality FROM labels WHERE toxic = 1")
def f8(spark, sf):
    return filters.malicious(inputs.table(spark, sf, "labels").withColumnRenamed("toxic", "label")).select("doc_id", "quality")


@query("F8_benign", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def f8_benign(spark, sf):
    return filters.benign(inputs.table(spark, sf, "labels").withColumnRenamed("toxic", "label")).select("doc_id", "quality")


@query("A1_class_distribution", "SELECT toxic AS label, count(*) AS row_count FROM labels GROUP BY toxic")
def a1(spark, sf):
    return reports.class_distribution(inputs.table(spark, sf, "labels").withColumnRenamed("toxic", "label"))


def judged(spark, sf):
    return inputs.table(spark, sf, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


REPORT = """WITH j AS (SELECT quality AS y, 1 - toxic AS p FROM labels),
    c AS (SELECT k, CASE k WHEN 0 THEN 'Benign' ELSE 'Malicious' END AS name, count(*) FILTER (y = k) AS support,
      count(*) FILTER (p = k) AS predicted, count(*) FILTER (y = k AND p = k) AS hit FROM j, (VALUES (0), (1)) v(k) GROUP BY k),
    m AS (SELECT *, CASE predicted WHEN 0 THEN 0 ELSE hit / predicted END AS precision, CASE support WHEN 0 THEN 0 ELSE hit / support END AS recall,
      CASE predicted + support WHEN 0 THEN 0 ELSE 2 * hit / (predicted + support) END AS f1 FROM c WHERE support + predicted > 0)
    SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM (
      SELECT name, precision, recall, f1, support FROM m
      UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM m
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM m)"""


@query("A3_classification_report", REPORT)
def a3(spark, sf):
    report = reports.classification_report(judged(spark, sf))
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "A4_confusion_matrix",
    """SELECT quality AS label, count(*) FILTER (toxic = 1) AS predicted_0, count(*) FILTER (toxic = 0) AS predicted_1
    FROM labels GROUP BY quality""",
)
def a4(spark, sf):
    return reports.confusion_matrix(judged(spark, sf))


@query("D2_require_rows", "SELECT doc_id FROM labels WHERE toxic = 0")
def d2(spark, sf):
    return require_rows(filters.benign(inputs.table(spark, sf, "labels").withColumnRenamed("toxic", "label")), "benign rows").select("doc_id")


@query(
    "U1_union_datasets",
    """SELECT dataset, count(*) AS n, sum(length(message))::BIGINT AS chars FROM (
    SELECT 'documents' AS dataset, text AS message FROM documents UNION ALL SELECT 'pages', html FROM pages
    UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY dataset""",
)
def u1(spark, sf):
    text = lambda t, c: inputs.table(spark, sf, t).select(F.col(c).alias("message"))
    union = union_datasets(
        {"documents": text("documents", "text"), "pages": text("pages", "html"), "conversations": text("conversations", "text"), "absent": None}
    )
    return union.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars"))


# One event type is more than a third of the rows below, the others stay under the threshold.
FILES = "SELECT *, CASE WHEN event_id % 5 < 2 THEN 'large' ELSE event_type END AS file FROM events"


@query(
    "U2_sample_large_files",
    f"""WITH f AS ({FILES}), n AS (SELECT file, count(*) AS n FROM f GROUP BY file),
    r AS (SELECT f.*, n, row_number() OVER (PARTITION BY file ORDER BY substr(md5('42|' || event_id), 1, 15)) AS k FROM f JOIN n USING (file))
    SELECT event_id, file FROM r WHERE n <= (SELECT count(*) // 4 FROM events) OR k <= round_even(0.05 * n, 0)""",
)
def u2(spark, sf):
    events = inputs.table(spark, sf, "events")
    parted = events.withColumn("file", F.when(F.col("event_id") % 5 < 2, "large").otherwise(F.col("event_type")))
    kept = sampling.sample_large_files(parted, 0.05, threshold=events.count() // 4, keys=("event_id",))
    return kept.select("event_id", "file")


@query(
    "U2_sample_by_content",
    """WITH f AS (SELECT CASE WHEN event_id % 5 < 2 THEN 'large' ELSE event_type END AS file, event_type, user_id % 40 AS k FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY file, event_type, k) AS copy, count(*) OVER (PARTITION BY file) AS n,
      sha256(length(event_type) || ':' || event_type || ',' || length(k::VARCHAR) || ':' || k) AS content FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY substr(md5('42|' || content || '|' || copy), 1, 15)) AS i FROM o)
    SELECT file, event_type, k, count(*) AS n FROM r WHERE n <= (SELECT count(*) // 4 FROM events) OR i <= round_even(0.05 * n, 0) GROUP BY ALL""",
)
def u2_content(spark, sf):
    """Rows that no column tells apart; what is kept follows from the rows alone."""
    events = inputs.table(spark, sf, "events")
    file = F.when(F.col("event_id") % 5 < 2, "large").otherwise(F.col("event_type"))
    rows = events.select(file.alias("file"), "event_type", (F.col("user_id") % 40).alias("k"))
    kept = sampling.sample_large_files(rows, 0.05, threshold=events.count() // 4)
    return kept.groupBy("file", "event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "U3_cap_rows",
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY substr(md5('42|' || event_id), 1, 15)) AS k,
    count(*) OVER () AS n FROM events) WHERE k <= n // 3""",
)
def u3(spark, sf):
    events = inputs.table(spark, sf, "events")
    return sampling.cap_rows(events, events.count() // 3, ("event_id",)).select("event_id")


SPLIT = """WITH l AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY substr(md5('42|' || doc_id), 1, 15)) AS k FROM labels),
    c AS (SELECT toxic, count(*) AS n, (SELECT ceil(round(0.2 * count(*), 9)) FROM labels) AS wanted, (SELECT count(*) FROM labels) AS total
      FROM labels GROUP BY toxic),
    q AS (SELECT toxic, floor(wanted * n / total) AS low, wanted,
      row_number() OVER (ORDER BY floor(wanted * n / total) - wanted * n / total, toxic) AS turn FROM c),
    s AS (SELECT toxic, low + CASE WHEN turn <= wanted - (SELECT sum(low) FROM q) THEN 1 ELSE 0 END AS size FROM q)
    SELECT doc_id, toxic AS label, k <= size AS in_test FROM l JOIN s USING (toxic)"""


@query("U4_stratified_split", SPLIT)
def u4(spark, sf):
    labels = inputs.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    train, test = sampling.stratified_split(labels, keys=("doc_id",))
    mark = lambda df, flag: df.select("doc_id", "label", F.lit(flag).alias("in_test"))
    return mark(train, False).unionByName(mark(test, True))


def write_flows(spark, sf):
    """Flow files written from the events: two headed spellings, one unusable, one headerless set."""
    path = scratch_path(spark, "flows")
    e = inputs.spread_table(spark, sf, "events", "event_id").select("event_id", "event_type", inputs.port_texts().alias("port"), inputs.raw_labels().alias("raw"))
    options = CSV_OPTIONS | {"encoding": "ISO-8859-1"}
    e.where("event_id % 2 = 0").select(
        F.col("event_id").alias("Flow ID"), F.col("port").alias(" Destination Port"), F.col("raw").alias("Label")
    ).write.options(**options).csv(f"{path}/headed")
    e.where("event_id % 2 = 1").select(
        F.col("event_type").alias("attack_cat"), F.col("raw").alias("LABEL"), F.col("port").alias("dst_port"), F.col("event_id").alias("n")
    ).write.mode("append").options(**options).csv(f"{path}/headed")
    e.select("event_id", "event_type").write.mode("append").options(**options).csv(f"{path}/headed")
    columns = {
        "dsport": F.col("port"), "attack_cat": F.when(F.col("event_id") % 4 != 0, F.col("event_type")),
        "Label": (F.col("event_id") % 2).cast("string"),
    }
    e.select(*[columns.get(c, F.lit("x")).alias(c) for c in flows.HEADERLESS_COLUMNS]).write.options(**options | {"header": False}).csv(f"{path}/headerless")
    return path


# Reading back turns missing texts, and spellings of a missing value, into null.
HEADED = sql(
    "SELECT port_text AS dest_port, raw_label, count(*) AS n FROM port_texts JOIN raw_labels USING (event_id) GROUP BY ALL", "port_texts", "raw_labels"
).replace("SELECT port_text AS", "SELECT nullif(port_text, '') AS")


@query("S3_read_flow_csv", HEADED)
def s3(spark, sf):
    headed = flows.read_flow_csv(spark, write_flows(spark, sf) + "/headed", "headed")
    return headed.groupBy("dest_port", "raw_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S3_flow_files",
    """SELECT reason, sum(n)::BIGINT AS "rows" FROM (SELECT NULL AS reason, count(*) AS n FROM events
    UNION ALL SELECT 'no column for label, port', count(*) FROM events) GROUP BY reason""",
)
def s3_files(spark, sf):
    """Every file is accounted for, the unusable ones with the reason."""
    report = flows.survey_flow_files(spark, write_flows(spark, sf) + "/headed")[1]
    return report.groupBy("reason").agg(F.sum("rows").alias("rows"))


@query(
    "S4_read_headerless_flows",
    sql(
        """SELECT nullif(port_text, '') AS dest_port, CASE WHEN event_id % 4 <> 0 THEN event_type END AS attack_cat,
        (event_id % 2)::VARCHAR AS raw_label, count(*) AS n FROM port_texts JOIN events USING (event_id) GROUP BY ALL""",
        "port_texts",
    ),
)
def s4(spark, sf):
    rows = flows.read_headerless_flows(spark, write_flows(spark, sf) + "/headerless", "headerless")
    return rows.groupBy("dest_port", "attack_cat", "raw_label").agg(F.count(F.lit(1)).alias("n"))
