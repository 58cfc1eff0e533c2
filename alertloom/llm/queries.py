"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_exact_dedup",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY x)
    """,
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf, "documents"), keep="largest")


@query("op2_simhash_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.simhash_dedup import simhash_groups

    return simhash_groups(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


END_ID = 2


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_token_output")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alertloom.llm.token_output import read_token_ids, write_token_ids
    from alertloom.runtime import scratch_path

    path = scratch_path(spark, "token-ids")
    write_token_ids(table(spark, sf, "documents"), path, tokenizer_file(), END_ID)
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_quality")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alertloom.llm.quality import fit_quality, held_out, score_quality

    docs = table(spark, sf, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _escaped(column: str) -> str:
    from alertloom.llm.chat import CONTROL

    text = f"replace({column}, '&', '&amp;')"
    for control in CONTROL:
        text = f"replace({text}, '{control}', '&#{ord(control[0])};{control[1:]}')"
    return text


@query(
    "op8_chat_format",
    f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length({_escaped("text")}) + CASE WHEN role = before THEN 8 ELSE 23 + length({_escaped("role")}) END)::BIGINT AS formatted_chars
    FROM m GROUP BY conv_id
    """,
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alertloom.llm.chat import chat_digests, format_chats, read_chats
    from alertloom.runtime import scratch_path

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = scratch_path(spark, "chats")
    format_chats(turns).write.parquet(path)
    return chat_digests(read_chats(spark.read.parquet(path)))


def _license_sql() -> str:
    import math

    from alertloom.llm.license_scan import CONTAINMENT, PHRASES, SPAN, TEMPLATES, template_words

    word = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
    places = " UNION ALL ".join(
        f"SELECT row, i, '{label}' AS label FROM w, unnest(range(len(words) - {phrase.count(' ')})) AS u(i) WHERE "
        + " AND ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    sets = ", ".join(
        f"('{label}', {template_words(text)!r}, {max(1, math.ceil(CONTAINMENT * len(template_words(text)) - 1e-9))}, {SPAN * len(template_words(text))})" for label, text in TEMPLATES
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    w AS (SELECT row, regexp_extract_all(x, '{word}') AS words FROM d),
    p AS ({places}),
    base AS (SELECT row, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY row),
    b AS (SELECT row, regexp_extract_all(block, '{word}') AS words FROM d, unnest(regexp_split_to_array(x, '[.!?]+[\\x09-\\x0D\\x20]+|\\r\\n[\\x09\\x0B\\x0C\\x20]*[\\n\\r]|\\n[\\x09\\x0B\\x0C\\x20]*[\\n\\r]|\\r[\\x09\\x0B\\x0C\\x20]*\\r|\\r[\\x09\\x0B\\x0C\\x20]+\\n')) AS u(block)),
    t(label, tokens, need, span) AS (VALUES {sets}),
    c AS (SELECT row, label, words, tokens, need, span FROM b, t WHERE len(words) >= need AND len(list_intersect(words, tokens)) >= need),
    m AS (SELECT row, label, size, shared FROM (SELECT row, label, need, len(tokens) AS size, list_max([len(list_intersect(words[i : i + span - 1], tokens)) FOR i IN range(1, len(words) + 1)]) AS shared FROM c) WHERE shared >= need),
    more AS (SELECT row, list(DISTINCT label) AS labels, max(shared / size) AS contained FROM m GROUP BY row)
    SELECT doc_id, len(words) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
        array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
        CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(contained, 0) END::DOUBLE AS score
    FROM d JOIN w USING (row) LEFT JOIN base USING (row) LEFT JOIN more USING (row)
    """


@query("op9_license_scan", _license_sql())
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf, "documents"))


# Letters of scripts without spaces are words, as in the operator.
_UNSPACED_SQL = "([\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Lao}\\p{Khmer}\\p{Myanmar}])"
_WORDS_SQL = f"""
    SELECT id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '{_UNSPACED_SQL}', ' \\1 ', 'g'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM %s
"""


@query(
    "op7_decontaminate",
    f"""
    WITH dw AS ({_WORDS_SQL % "(SELECT doc_id AS id, text FROM documents)"}), bw AS ({_WORDS_SQL % "(SELECT item_id AS id, text FROM benchmark)"}),
    d AS (SELECT DISTINCT id, words[i + 1 : i + 5] AS s FROM dw, unnest(range(len(words) - 4)) AS u(i)),
    b AS (SELECT DISTINCT id, words[i + 1 : i + 5] AS s FROM bw, unnest(range(len(words) - 4)) AS u(i)),
    n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
    SELECT d.id AS doc_id, b.id AS item_id, any_value(n)::INTEGER AS n_shingles, count(*)::INTEGER AS shared, count(*) / any_value(n) AS containment
    FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n)
    UNION ALL
    SELECT dw.id, bw.id, 1, 1, 1.0 FROM bw JOIN dw ON contains(' ' || array_to_string(dw.words, ' ') || ' ', ' ' || array_to_string(bw.words, ' ') || ' ')
    WHERE len(bw.words) BETWEEN 1 AND 4
    """,
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("row")


@query("op10_repeats")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alertloom.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_line_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from alertloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents' language as their domain."""
    return docs.select("doc_id", "lang").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


@query("op5_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.common import settled
    from alertloom.llm.mixing import document_rates, domain_posteriors, fit_domains, fit_rates

    docs = table(spark, sf, "documents")
    model = fit_domains(docs, domain_labels(docs, table(spark, sf, "labels")), "lang")
    posteriors = settled(domain_posteriors(docs, model), "posteriors")
    return document_rates(posteriors, fit_rates(posteriors, model))


@query(
    "op13_minhash_dedup",
    """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
    ),
    s AS (
        SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct([array_to_string(words[i + 1 : i + 4], ' ') FOR i IN range(greatest(len(words) - 3, 1))])) END AS s FROM w
    ),
    g AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
    t AS (SELECT id, n, unnest(s) AS h FROM g),
    links AS (
        SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.h = b.h AND a.id <> b.id
        GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    reached(id, to_id) AS (SELECT id, id FROM g UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.to_id),
    roots AS (SELECT id, min(to_id) AS root FROM reached GROUP BY id)
    SELECT doc_id, len(s.s) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
    FROM s LEFT JOIN g ON g.s = s.s LEFT JOIN roots ON roots.id = g.id
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.minhash_dedup import minhash_groups

    return minhash_groups(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def _audit_sql() -> str:
    from alertloom.llm.filter_audit import FILTERS

    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    fails = {
        "A": "len(words) < 100", "B": "100 * len(list_distinct(words)) < 80 * len(words)", "C": "100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)",
        "D": "regexp_matches(text, '[#$%&*|]')", "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)",
    }
    at = lambda k: " OR ".join(f"substr(o, {i}, 1) = '{x}' AND {x}" for i, x in [(k, f) for f in FILTERS])
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {words} AS words FROM documents),
    l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT doc_id, part, {", ".join(f"{e} AS {x}" for x, e in fails.items())} FROM d),
    m AS (SELECT part, A, B, C, D, E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    p AS (SELECT DISTINCT part FROM m),
    x AS (SELECT unnest(string_split('{FILTERS}', '')) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    r AS (SELECT part, o, A, B, C, D, E, good, toxic, n, CASE {" ".join(f"WHEN {at(k)} THEN {k}" for k in range(1, 6))} ELSE 6 END AS gone FROM m, o),
    k AS (SELECT o, k AS step, substr(o, k, 1) AS x FROM o, unnest(range(1, 6)) AS u(k)),
    s AS (
        SELECT p.part, k.o AS filter_order, k.step, k.x,
            sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN gone < step AND CASE x {" ".join(f"WHEN '{x}' THEN {x}" for x in FILTERS)} END THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN A::INT + B::INT + C::INT + D::INT + E::INT = 1 AND CASE x {" ".join(f"WHEN '{x}' THEN {x}" for x in FILTERS)} END THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost
        FROM p JOIN k ON true JOIN r ON r.part = p.part AND r.o = k.o GROUP BY p.part, k.o, k.step, k.x
    )
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
        good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
    FROM s
    """


@query("op11_filter_audit", _audit_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: The unsigned CRC-32 of a number's decimal digits, bit by bit.
_CRC_SQL = (
    "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), "
    "lambda c, x: list_reduce([xor(c, x)] || range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
)


@query(
    "op12_prefix_trie",
    f"""
    WITH t AS (
        SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    c AS (SELECT conv_id, count(*) AS n, conv_id - (conv_id % 5 + 5) % 5 AS base, {_CRC_SQL} % 9 AS h FROM t GROUP BY conv_id),
    k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
    r AS (
        SELECT conv_id, k + pos - h AS q, x, text FROM t JOIN k USING (conv_id) WHERE pos >= h
        UNION ALL SELECT k.conv_id, pos, x, text FROM k JOIN t ON t.conv_id = k.base WHERE pos < k
    ),
    p AS (
        SELECT conv_id, q + 1 AS depth, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY q) AS path, strlen(text) AS size FROM r
        UNION ALL SELECT conv_id, 0, '', 0 FROM c
    ),
    l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
    e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY path),
    n AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(size) AS size, left(path, 64 * (any_value(depth) - 1)) AS parent FROM p GROUP BY path),
    m AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.path AND x.depth = n.depth + 1) AS n_children FROM n),
    s AS (
        SELECT a.path, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n_convs - 1) * m.size) AS saved
        FROM m, unnest(range(m.depth + 1)) AS u(i) JOIN n a ON a.path = left(m.path, 64 * i) GROUP BY a.path
    )
    SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n o ON o.path = m.parent AND m.depth > 0
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from alertloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf, "conversations"))
