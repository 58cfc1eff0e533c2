"""Vectors, both models, and the jobs that train and use them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from alertloom.functions.features import FEATURES, engineer_features
from alertloom.models import anomaly, classifier, detector as D, vectorise
from alertloom.models.training import train_detector
from alertloom.plans import jobs
from alertloom.runtime import scratch_path, settle
from alertloom.sources import flows
from alertloom.sources.alerts import CSV_OPTIONS, read_alert_table, write_alerts
from alertloom.sources.suggestions import stored_rules
from checks import inputs
from checks.registry import query
from checks.tables import sql

SCALED = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE stddev_pop({c}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS z_{c}" for c in FEATURES
)


@query("M1_standardise", sql(f"SELECT page_id, {SCALED} FROM page_features", "page_messages", "page_features"))
def m1(spark, sf):
    scaled = vectorise.standardise(inputs.page_features(spark, sf))
    return scaled.select("page_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in FEATURES])


WORDS = """words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
    uses AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL),
    terms AS (SELECT term, sum(n)::BIGINT AS uses, count(*) AS "rows" FROM uses GROUP BY term ORDER BY uses DESC, term LIMIT 1000)"""


def documents(spark, sf):
    return inputs.spread_table(spark, sf, "documents", "doc_id").select("doc_id", F.col("text").alias("message"))


@query("W5_top_terms", f"WITH {WORDS} SELECT term, uses, \"rows\" FROM terms")
def w5(spark, sf):
    return vectorise.top_terms(documents(spark, sf))


@query("W5_top_terms_by_sketch", f"WITH {WORDS} SELECT term, uses, \"rows\" FROM (SELECT * FROM terms ORDER BY uses DESC, term LIMIT 40)")
def w5_sketch(spark, sf):
    """The same terms where a sketch proposes them and exact counts decide."""
    return vectorise.top_terms(documents(spark, sf), 40, sketch=True)


@query("M2_inverse_frequency", f"WITH {WORDS} SELECT term, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + \"rows\")) + 1, 6) AS idf FROM terms")
def m2_idf(spark, sf):
    df = documents(spark, sf)
    idf = vectorise.inverse_frequency(F.lit(df.count()), F.col("rows"))
    return vectorise.top_terms(df).select("term", F.round(idf, 6).alias("idf"))


VECTORS = f"""WITH {WORDS}, raw AS (SELECT doc_id, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + "rows")) + 1) AS w FROM uses JOIN terms t USING (term)),
    norm AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM raw GROUP BY doc_id)"""


@query(
    "M2_tfidf",
    VECTORS + """ SELECT d.doc_id, count(w) AS terms, round(coalesce(sum(w / len), 0), 5) AS weight, round(coalesce(max(w / len), 0), 5) AS largest
    FROM documents d LEFT JOIN raw USING (doc_id) LEFT JOIN norm USING (doc_id) GROUP BY d.doc_id""",
)
def m2(spark, sf):
    from pyspark.ml import PipelineModel

    df = documents(spark, sf)
    values = F.unwrap_udt("text_vector")["values"]
    vectors = PipelineModel(vectorise.tfidf_stages(df, df.count())).transform(df).select("doc_id", values.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return vectors.select(
        "doc_id", F.size("v").cast("long").alias("terms"), F.round(total, 5).alias("weight"),
        F.round(F.coalesce(F.array_max("v"), F.lit(0.0)), 5).alias("largest"),
    )


def document_features(spark, sf):
    d = inputs.spread_table(spark, sf, "documents", "doc_id").select("doc_id", F.col("text").alias("message"), (F.col("doc_id") % 1024).alias("dest_port"))
    return engineer_features(d, keep=("doc_id",))


NUMBERS = """counted AS (SELECT doc_id, doc_id % 1024 AS dest_port, length(text) AS message_length,
      len(regexp_extract_all(text, '[\\$\\{\\}\\(\\)''\\/]')) AS special_char_count,
      len(regexp_extract_all(lower(text), 'select|union|script|jndi|ldap|payload|attack|exploit|scan')) AS keyword_count FROM documents)"""
Z_SUM = " + ".join(f"({c} - avg({c}) OVER ()) / CASE stddev_pop({c}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({c}) OVER () END" for c in FEATURES)


@query(
    "M3_assemble",
    f"""{VECTORS}, {NUMBERS}, z AS (SELECT doc_id, {Z_SUM} AS z FROM counted),
    t AS (SELECT doc_id, sum(w / len) AS s FROM raw JOIN norm USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, 4 + (SELECT count(*) FROM terms) AS width, round(z + coalesce(s, 0), 5) AS total FROM z LEFT JOIN t USING (doc_id)""",
)
def m3(spark, sf):
    df = document_features(spark, sf)
    vectors = vectorise.vectorised(vectorise.fit_vectoriser(df), df).select("doc_id", vector_to_array("features").alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("doc_id", F.size("a").cast("long").alias("width"), F.round(total, 5).alias("total"))


def labelled(spark, sf):
    return engineer_features(inputs.labelled(spark, sf), keep=("row_id", "label"))


#: Words that no text holds; rows and packets with them are the planted attacks.
MARKS = " ".join(f"zq{k:02d}" for k in range(60))
PLANTED = f"(repeat('{MARKS} ', 20) || {{}})"


def planted(spark, sf):
    """Labelled documents in which the label can be learned: attacks hold the marks, many times."""
    rows = inputs.labelled(spark, sf)
    marked = F.concat(F.repeat(F.lit(MARKS + " "), 20), F.coalesce("message", F.lit("")))
    return engineer_features(rows.withColumn("message", F.when(F.col("label") == 1, marked).otherwise(F.col("message"))), keep=("row_id", "label"))


def planted_packets(spark, sf):
    """The packets; one in seven of those long enough holds the marks before its text."""
    packets = inputs.packets(spark, sf)
    marked = F.concat(F.encode(F.repeat(F.lit(MARKS + " "), 20), "UTF-8"), "payload")
    there = (F.col("packet_id") % 7 == 3) & (F.octet_length("payload") >= 5)
    return packets.withColumn("payload", F.when(there, marked).otherwise(F.col("payload")))


INSPECTED = ("packets", "outside", "inspected")
#: Inspected packets that hold the marks, and what their prompts show.
ATTACKS = f"""SELECT packet_id, src_ip, protocol, dst_port::BIGINT AS dest_port, 1 AS rf,
    md5(replace(replace({{prompt}}, '{{{{0}}}}', protocol), '{{{{1}}}}', dst_port::VARCHAR)) AS digest FROM inspected WHERE packet_id % 7 = 3"""


def _attacks():
    from alertloom.functions.rule_text import PACKET_PROMPT

    # The first hundred characters are marks, without quotes or line feeds.
    prompt = PACKET_PROMPT.replace("{2}", (MARKS + " ")[:100])
    return sql(ATTACKS.format(prompt="'" + prompt.replace("'", "''") + "'").replace("{{", "{").replace("}}", "}"), *INSPECTED)


@query("M4_train_classifier", "SELECT doc_id AS row_id, toxic AS label, toxic AS rf FROM documents JOIN labels USING (doc_id)")
def m4(spark, sf):
    """Every row of a table with planted attacks is judged as it is labelled."""
    rows = settle(planted(spark, sf))
    model = classifier.train_classifier(rows)
    return classifier.classify(model, rows).select("row_id", "label", "rf")


def embeddings(spark, sf):
    return inputs.table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


DEPTH = 8


@query(
    "M5_train_anomaly",
    f"""SELECT tree::INTEGER AS tree, least(256, (SELECT count(*) FROM embeddings)) AS root_rows, least(256, (SELECT count(*) FROM embeddings)) AS leaf_rows,
    true AS parts_add_up, true AS children_below, true AS shallow FROM range(100) t(tree)""",
)
def m5(spark, sf):
    """What must hold of each tree: it starts from its sample, splits add up, every node but the root hangs below one."""
    nodes = settle(anomaly.train_anomaly(embeddings(spark, sf), ("vec_id",)))
    child = nodes.select("tree", F.col("node").alias("c"), F.col("size").alias("s"), F.col("depth").alias("d"))
    split = nodes.where("feature >= 0").select("tree", "node", "size", "depth", F.explode(F.array("left", "right")).alias("c"))
    below = split.join(child, ["tree", "c"], "left").groupBy("tree", "node", "size", "depth").agg(
        F.sum("s").alias("s"), F.count("s").alias("n"), F.bool_and(F.col("d") == F.col("depth") + 1).alias("ok")
    )
    splits = below.groupBy("tree").agg(
        F.bool_and((F.col("s") == F.col("size")) & (F.col("n") == 2)).alias("parts_add_up"), F.bool_and("ok").alias("children_below"), F.count(F.lit(1)).alias("splits")
    )
    leaf = F.col("feature") < 0
    trees = nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).cast("long").alias("root_rows"), F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        (F.max("depth") <= DEPTH).alias("shallow"), F.count(F.lit(1)).alias("nodes"),
    )
    # A binary tree has one node more than twice its splits.
    return trees.join(splits, "tree").select("tree", "root_rows", "leaf_rows", "parts_add_up", (F.col("children_below") & (F.col("nodes") == 2 * F.col("splits") + 1)).alias("children_below"), "shallow")


def walked_scores(vectors, nodes, sample):
    """Scores by joins: each row goes down each tree one level a join, and path lengths are averaged."""
    at = vectors.select("vec_id", vector_to_array("features").alias("x")).join(F.broadcast(nodes.where("node = 0")), F.lit(True))
    places = at.select("vec_id", "x", "tree", "feature", "threshold", "left", "right", "size", "depth")
    below = nodes.withColumnsRenamed({c: f"_{c}" for c in nodes.columns})
    for _ in range(DEPTH):
        goes = F.when(F.col("feature") < 0, F.lit(None)).when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        places = places.withColumn("to", goes).join(F.broadcast(below), (F.col("tree") == F.col("_tree")) & (F.col("to") == F.col("_node")), "left")
        places = places.select("vec_id", "x", "tree", *[F.coalesce(f"_{c}", c).alias(c) for c in ("feature", "threshold", "left", "right", "size", "depth")])
    mean = lambda n: F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + anomaly.EULER_GAMMA) - 2 * (n - 1) / n)
    path = F.col("depth") + mean(F.col("size").cast("double"))
    return places.groupBy("vec_id").agg(F.pow(F.lit(2.0), -F.avg(path) / mean(F.lit(float(sample)))).alias("walked"))


@query("M6_score_anomaly", "SELECT vec_id, true AS same_score, true AS threshold_kept FROM embeddings UNION ALL SELECT -1 - vec_id, true, true FROM embeddings WHERE vec_id % 10 = 0")
def m6(spark, sf):
    """Scores equal those of a walk by joins, and the class follows the threshold; planted rows far outside are anomalies."""
    vectors = embeddings(spark, sf)
    far = vectors.where("vec_id % 10 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), array_to_vector(F.transform(vector_to_array("features"), lambda x: x * 20)).alias("features"))
    rows = settle(vectors.select("vec_id", "features").unionByName(far))
    nodes = settle(anomaly.train_anomaly(vectors, ("vec_id",)))
    sample = nodes.where("node = 0").agg(F.max("size")).first()[0]
    both = anomaly.score_anomaly(rows, nodes).join(walked_scores(rows, nodes, sample), "vec_id")
    kept = (F.col("iforest") == F.when(F.col("anomaly_score") > 0.5, -1).otherwise(1)) & ((F.col("vec_id") >= 0) | (F.col("iforest") == -1))
    return both.select("vec_id", (F.abs(F.col("anomaly_score") - F.col("walked")) < 1e-9).alias("same_score"), kept.alias("threshold_kept"))


@query(
    "M7_hybrid_alert",
    """SELECT doc_id, toxic = 1 OR quality = 0 AS is_alert, toxic = 1 AS classifier_alert FROM labels""",
)
def m7(spark, sf):
    iforest = F.when(F.col("quality") == 0, -1).otherwise(1)
    return inputs.table(spark, sf, "labels").select(
        "doc_id", D.hybrid_alert(F.col("toxic"), iforest).alias("is_alert"),
        D.hybrid_alert(F.col("toxic"), iforest, "classifier").alias("classifier_alert"),
    )


def planted_detector(spark, sf):
    """Both models on all labelled documents, the attacks planted; trained anew by each query that applies them."""
    return train_detector(settle(planted(spark, sf)), ("row_id",), trees=20, max_depth=8)[0]


@query(
    "S10_save_and_load_models",
    "SELECT doc_id AS row_id, true AS same_class, true AS same_score FROM documents JOIN labels USING (doc_id)",
)
def s10(spark, sf):
    """Reloaded models judge every row like the fitted ones."""
    model = planted_detector(spark, sf)
    path = scratch_path(spark, "models")
    D.save_models(model, path)
    rows = settle(planted(spark, sf))

    def judged(detector, mark):
        classes = classifier.classify(detector.classifier, rows)
        scored = anomaly.score_anomaly(vectorise.vectorised(detector.vectoriser, classes), detector.nodes)
        return scored.select("row_id", F.col("rf").alias(f"rf{mark}"), F.col("anomaly_score").alias(f"s{mark}"))

    both = judged(model, 1).join(judged(D.load_models(spark, path), 2), "row_id")
    return both.select("row_id", (F.col("rf1") == F.col("rf2")).alias("same_class"), (F.col("s1") == F.col("s2")).alias("same_score"))


def shown(alerts):
    """Alerts that the first model raises; those of the other alone follow no rule that SQL could state."""
    return alerts.where("rf = 1").select("packet_id", "src_ip", "protocol", F.col("dest_port").cast("long").alias("dest_port"), "rf", F.md5("prompt").alias("digest"))


@query("M8_score_packets", _attacks())
def m8(spark, sf):
    """All planted attacks are found and no other packet is taken for one."""
    return shown(D.score_packets(planted_detector(spark, sf), planted_packets(spark, sf)))


def written_alerts(spark, sf):
    """An alert table of the events' lines."""
    from alertloom.operators.alerts import parse_alerts

    path = scratch_path(spark, "alerts")
    write_alerts(parse_alerts(inputs.alert_lines(spark, sf)), path)
    return path


def flow_sets(spark, sf):
    """Two headed files and the headerless set from the events, and the alerts."""
    from checks.feature_queries import write_flows

    path = write_flows(spark, sf)
    return {
        "headed": flows.read_flow_csv(spark, f"{path}/headed", "headed"),
        "headerless": flows.read_headerless_flows(spark, f"{path}/headerless", "headerless"),
        "absent": None,
        "alerts": read_alert_table(spark, written_alerts(spark, sf)),
    }


@query(
    "C2_training_features",
    sql(
        """SELECT dataset, label, message, count(*) AS n, sum(message_length)::BIGINT AS chars FROM (
        SELECT 'headed' AS dataset, CASE WHEN contains(lower(coalesce(raw_label, 'nan')), 'benign') OR contains(lower(coalesce(raw_label, 'nan')), 'normal')
          OR contains(coalesce(raw_label, 'nan'), '0') THEN 0 ELSE 1 END AS label, coalesce(raw_label, 'nan') AS message, length(coalesce(raw_label, 'nan')) AS message_length FROM raw_labels
        UNION ALL SELECT 'headerless', CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 4 <> 0 THEN event_type ELSE 'Unknown Attack' END,
          length(CASE WHEN event_id % 4 <> 0 THEN event_type ELSE 'Unknown Attack' END) FROM events
        UNION ALL SELECT 'alerts', 1, event_type, length(event_type) FROM events WHERE event_id % 10 <> 9) GROUP BY ALL""",
        "raw_labels",
    ),
)
def c2_features(spark, sf):
    from alertloom.operators.union import union_datasets

    sets = flow_sets(spark, sf)
    sets |= {k: jobs.labelled_features(v) for k, v in sets.items() if v is not None and k != "alerts"}
    sets["alerts"] = jobs.alert_features(sets["alerts"])
    return union_datasets(sets).groupBy("dataset", "label", "message").agg(F.count(F.lit(1)).alias("n"), F.sum("message_length").alias("chars"))


def learnable_flows(spark, sf):
    """Flow files and alerts whose message, the label's text, says what they are; as in the reference it leaks."""
    path = scratch_path(spark, "flows")
    e = inputs.table(spark, sf, "events")
    port, kind = (F.col("event_id") % 1024).cast("string"), F.col("event_type")
    label = F.when(F.col("event_id") % 4 == 0, "BENIGN").when(F.col("event_id") % 4 == 1, "normal traffic").when(F.col("event_id") % 4 == 2, "DDoS flood").otherwise(F.concat(F.lit("Bot net "), kind))
    options = CSV_OPTIONS | {"encoding": "ISO-8859-1"}
    e.select(port.alias("Dst Port"), label.alias("Label")).write.options(**options).csv(f"{path}/headed")
    columns = {"dsport": port, "attack_cat": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Exploits of "), kind)), "Label": (F.col("event_id") % 3 == 0).cast("int").cast("string")}
    e.select(*[columns.get(c, F.lit("x")).alias(c) for c in flows.HEADERLESS_COLUMNS]).write.options(**options | {"header": False}).csv(f"{path}/headerless")
    return {
        "headed": flows.read_flow_csv(spark, f"{path}/headed", "headed"), "headerless": flows.read_headerless_flows(spark, f"{path}/headerless", "headerless"),
        "absent": None, "alerts": read_alert_table(spark, written_alerts(spark, sf)),
    }


@query(
    "C2_training_job",
    """WITH l AS (SELECT CASE WHEN event_id % 4 < 2 THEN 0 ELSE 1 END AS y FROM events UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END FROM events
      UNION ALL SELECT 1 FROM events WHERE event_id % 10 <> 9),
    c AS (SELECT y, count(*) AS n, (SELECT ceil(round(0.2 * count(*), 9)) FROM l) AS wanted, (SELECT count(*) FROM l) AS total FROM l GROUP BY y),
    q AS (SELECT y, floor(wanted * n / total) AS low, wanted, row_number() OVER (ORDER BY floor(wanted * n / total) - wanted * n / total, y) AS turn FROM c),
    s AS (SELECT y, (low + CASE WHEN turn <= wanted - (SELECT sum(low) FROM q) THEN 1 ELSE 0 END)::BIGINT AS support FROM q)
    SELECT CASE y WHEN 0 THEN 'Benign' ELSE 'Malicious' END AS name, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, support FROM s
    UNION ALL SELECT 'accuracy', NULL, NULL, 1.0, sum(support)::BIGINT FROM s UNION ALL SELECT 'macro avg', 1.0, 1.0, 1.0, sum(support)::BIGINT FROM s
    UNION ALL SELECT 'weighted avg', 1.0, 1.0, 1.0, sum(support)::BIGINT FROM s""",
)
def c2(spark, sf):
    """Report of a classifier trained on all flow rows and alerts, with the messages telling the classes apart."""
    _, report, _ = jobs.training_job(learnable_flows(spark, sf))
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "C4_inspection_job",
    sql(
        r"""SELECT sid, CASE WHEN contains(rule, 'sid:') THEN regexp_replace(rule, 'sid:\s*[0-9]+;', 'sid:' || sid || ';', 'g')
        ELSE regexp_replace(rule, ';\)$', '; sid:' || sid || '; rev:1;)') END AS rule FROM (
          SELECT min(rule) AS rule, 3000000 - 1 + row_number() OVER (ORDER BY md5(k)) AS sid FROM (
            SELECT c.rule, regexp_replace(regexp_replace(c.rule, '\s*(sid|rev):\s*[0-9]+;', '', 'g'), ';[\s;]*;', ';', 'g') AS k
            FROM clean_packet_rules c JOIN inspected ON packet_id = c.event_id WHERE c.rule IS NOT NULL AND c.event_id % 7 = 3) GROUP BY k)""",
        *INSPECTED, "packet_rules", "clean_packet_rules",
    ),
)
def c4(spark, sf):
    """Answers to the prompts of planted attacks become stored suggestions; a second run stores none twice."""
    model = planted_detector(spark, sf)
    packets, store = settle(planted_packets(spark, sf)), scratch_path(spark, "suggestions")
    answers = inputs.table(spark, sf, "events").where("event_id % 7 = 3").select(F.col("event_id").alias("prompt_id"), inputs.packet_responses().alias("response"))
    alerts, rules = jobs.inspection_job(model, packets, answers, 3000000, store=store)
    jobs.packet_suggestions(answers.join(alerts.select(F.col("packet_id").alias("prompt_id")), "prompt_id", "left_semi"), 4000000, store=store)
    stored = stored_rules(spark, store)
    return stored.join(rules.select("sid", "rule_key"), "rule_key", "left").select("sid", "rule")
