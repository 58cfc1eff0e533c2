from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.functions import rule_text as R
from alertloom.operators import joins, numbering, thresholds
from alertloom.plans import jobs
from alertloom.sources import rules as rules_io, suggestions
from checks import inputs

HEAD = 'alert tcp any any -> $HOME_NET 80 (msg:"x"; content:"y"'


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "v string").select(expression(F.col("v"))).first()[0]


def test_packet_rules(spark):
    clean = lambda text: tuple(one(spark, text, R.sanitise_packet_rule))
    assert clean(f"Here: {HEAD}; sid:1;)\nbye") == (f"{HEAD}; sid:1;)", None)
    assert clean(f"{HEAD})") == (f"{HEAD};)", None)
    assert clean('alert tcp\nany (content:"database(), user()")') == ('alert tcp any (content:"database(), user()";)', None)
    assert clean(HEAD + '; "odd;)')[1] == "unbalanced quotes"
    assert clean("no") == (None, "no rule") and clean(None) == (None, "no rule")


def test_numbers(spark):
    with_sid = lambda text: one(spark, text, lambda c: R.with_sid(c, F.lit(9)))
    assert with_sid(HEAD + ";)") == HEAD + "; sid:9; rev:1;)"
    assert with_sid(HEAD + "; sid: 5; rev:2;)") == HEAD + "; sid:9; rev:2;)"
    mined = lambda text, mode: one(spark, text, lambda c: R.with_mined_sid(c, F.lit(9), mode))
    rule = 'alert tcp (content:"user()"; sid:1; rev:3;) end'
    assert mined(rule, "last") == 'alert tcp (content:"user()"; sid:9; rev:1;) end'
    assert mined(rule, "reference") == 'alert tcp (content:"user(; sid:9; rev:1;)";  rev:3;; sid:9; rev:1;) end'


def test_mined_rules(spark):
    clean = lambda text: one(spark, text, R.sanitise_mined_rule)
    assert clean("```snort\nalert tcp (x)\n```") == "alert tcp (x)"
    assert clean("alert SRC IP 1.2.3.4 tcp   dst port 80 (x)") == "alert tcp (x)"


def test_suggestions(spark):
    clean = lambda text, mode="last": one(spark, text, lambda c: R.sanitise_suggestion(c, mode))
    assert clean("bash\nalert  tcp (a;)\n``` note") == "alert tcp (a;)"
    assert clean('alert tcp (content:"f();x"; sid:1;)') == 'alert tcp (content:"f();x"; sid:1;)'
    assert clean('alert tcp (content:"f();x"; sid:1;)', "reference") == 'alert tcp (content:"f();'
    assert clean("nothing") is None and clean("") is None
    assert clean("logger alerting drop x") == "drop x"


def test_hint_and_prompt(spark):
    hint = lambda text: one(spark, text, R.payload_hint)
    assert (hint("a payload=abc rest"), hint("payload=apayload=b"), hint("none")) == ("abc", "a", "unknown")
    prompt = one(spark, 'a"b\nc', lambda c: R.packet_prompt(F.lit("tcp"), F.lit(80), c))
    assert '- Payload: "a\\"b c"' in prompt and "1. Start with: alert tcp any any -> $HOME_NET 80" in prompt
    long = one(spark, "z" * 300, lambda c: R.packet_prompt(F.lit("tcp"), F.lit(80), c))
    assert "z" * 100 in long and "z" * 101 not in long


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = numbering.number_rows(df, ["k"], 100, "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(k, k + 100) for k in range(1000)]
    assert numbering.number_rows(df.limit(0), ["k"], 1, "n").count() == 0


def test_numbering_has_no_fixed_parts(spark, monkeypatch):
    """The rows of a task follow the session's number of partitions, and a common leading key is cut like any other."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("hot"), "id")
        sizes = [r["count"] for r in numbering.ordered(df, ["hot", "id"]).groupBy("_part").count().collect()]
        assert len(sizes) >= 30 and max(sizes) < 3 * 20_000 / 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    monkeypatch.setattr(numbering, "BLOCK", 64)
    totals = numbering.running_totals(df, ["id"], {"t": "hot", "n": "id"}).collect()
    seen = 0
    for r in sorted(totals, key=lambda r: r.id):
        seen += r.hot
        assert r.t == seen and r.n == r.id * (r.id + 1) // 2


RULES = [
    'alert tcp any any -> $HOME_NET 22 (msg:"SSH"; flow:to_server,established; content:"SSH-", nocase; '
    "detection_filter: track by_src, count 5, seconds 60; sid:1000002; rev:1;)",
    'alert tcp any any -> $HOME_NET any (msg:"FIN"; flags: F,1; sid:1000001; rev:1;)',
    'alert tcp any any -> $HOME_NET 80 (content:"POST /u HTTP/1.1\\r\\nHost: "; msg:"Up; load"; sid:7; rev:1;)',
    "# comment", "", "include x",
]


def test_rule_table(spark):
    table = rules_io.rules_from_lines(spark.createDataFrame([(r,) for r in RULES], "value string"))
    rows = {r["sid"]: r for r in table.collect()}
    assert set(rows) == {1000002, 1000001, 7}
    ssh = rows[1000002]
    assert (ssh["df_track"], ssh["df_count"], ssh["df_seconds"], ssh["flow"]) == ("by_src", 5, 60, ["to_server", "established"])
    assert [tuple(c) for c in ssh["contents"]] == [("SSH-", True)]
    assert (rows[1000001]["flags"], rows[1000001]["dst_port"]) == ("F", None)
    assert rows[7]["contents"][0]["text"] == "POST /u HTTP/1.1\r\nHost: " and rows[7]["msg"] == "Up; load"
    assert rows[7]["options"]["sid"] == "7"


def test_large_rule_tables_give_the_same_matches(spark, sf, monkeypatch):
    packets, rules = inputs.packets(spark, sf), inputs.rules(spark)
    pairs = lambda df: sorted((r["packet_id"], r["sid"]) for r in df.select("packet_id", "sid").collect())
    small = pairs(joins.match_rules(packets, rules))
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    salted = joins.match_rules(packets, rules, salts=4)
    assert pairs(salted) == small and small


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


def test_detection_filter(spark):
    times = {"a": [0, 10, 20, 80, 80, 80, 300], "b": [0, 60, 119, 178], "c": [5, 5, 5]}
    rows = [(f"{s}{k}", 1, s, at(t)) for s, ts in times.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "id string, sid int, src_ip string, ts timestamp")
    got = thresholds.detection_filter(df, "src_ip", 3, 60)
    # b: 119 - 0 is out of reach and 178, 119, 60 span more than a minute.
    assert sorted(r["id"] for r in got.collect()) == ["a2", "a3", "a4", "a5", "c0", "c1", "c2"]


def test_detection_filter_spacing(spark):
    rows = [(k, 1, "s", at(60 * k)) for k in range(5)]
    df = spark.createDataFrame(rows, "id int, sid int, src_ip string, ts timestamp")
    assert thresholds.detection_filter(df, "src_ip", 2, 60).count() == 0
    assert thresholds.detection_filter(df, "src_ip", 2, 61).count() == 4


def test_detection_filter_equals_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [(k, rnd.choice((1, 2)), "hot" if rnd.random() < 0.5 else f"s{rnd.randrange(5)}", at(rnd.randrange(-400, 400))) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, sid int, src_ip string, ts timestamp")
    want = sorted(
        a[0] for a in rows
        if sum(b[1:3] == a[1:3] and timedelta(0) <= a[3] - b[3] < timedelta(seconds=30) for b in rows) >= 6
    )
    assert sorted(r["id"] for r in thresholds.detection_filter(df, "src_ip", 6, 30).collect()) == want and want


def test_flood_of_one_source(spark, monkeypatch):
    """One source sends most rows within a second, a third of them at one instant: windows stay small and the answer is that of brute force."""
    monkeypatch.setattr(numbering, "BLOCK", 256)
    rows = [(k, 1, "flood", at(100) + timedelta(microseconds=0 if k % 3 == 0 else 97 * k)) for k in range(9000)]
    rows += [(9000 + k, k % 3, None if k % 7 == 0 else f"s{k % 5}", at(k / 3)) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, sid int, src_ip string, ts timestamp").withColumn("n", F.lit("kept"))
    want, sources = [], {}
    for r in rows:
        sources.setdefault(r[1:3], []).append(r[3])
    for r in rows:
        times = sources[r[1:3]]
        if r[2] == "flood":
            # Time runs with the place among the rows that are not at the first instant.
            n = 3000 + (0 if r[0] % 3 == 0 else r[0] - r[0] // 3)
        else:
            n = sum(timedelta(0) <= r[3] - t < timedelta(seconds=30) for t in times)
        if n >= 6:
            want.append(r[0])
    got = thresholds.detection_filter(df, "src_ip", 6, 30)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want)
    assert 0 < len([i for i in want if i >= 9000]) < 900
    alerts = df.selectExpr("id", "1L gid", "1L sid", "src_ip", "ts event_ts", "'alert' action")
    held = thresholds.rate_filter(alerts, 1, 1, "src_ip", 6, 30, "drop", 40).where("action = 'drop'")
    crossed = thresholds.detection_filter(df.withColumn("sid", F.lit(1)), "src_ip", 6, 30)
    reach = alerts.join(crossed.select("src_ip", F.col("ts").alias("c")).distinct(), "src_ip", "left").where("c IS NULL OR (event_ts >= c AND event_ts < c + INTERVAL 40 SECONDS)")
    named = lambda d: {r.id for r in d.where("src_ip <> 'flood' AND src_ip IS NOT NULL").select("id").collect()}
    assert named(held) == named(reach.where("c IS NOT NULL")) and held.where("src_ip = 'flood'").count() == 9000


def test_suppress_forms(spark):
    alerts = spark.createDataFrame(
        [(1, 1, 5, "a", "x"), (2, 1, 5, "b", "x"), (3, 1, 6, "a", "x"), (4, 2, 5, "c", "y"), (5, 1, 7, "d", "z")],
        "id int, gid int, sid long, source_ip string, dest_ip string",
    )
    kept = lambda rows: sorted(
        r["id"] for r in joins.suppress(alerts, spark.createDataFrame(rows, "gid int, sid long, track string, ip string")).collect()
    )
    assert kept([(1, 5, None, None)]) == [3, 4, 5]
    assert kept([(1, 5, "by_src", "a")]) == [2, 3, 4, 5]
    assert kept([(None, None, "by_dst", "x")]) == [4, 5]
    assert kept([(None, 5, None, None), (None, None, "by_src", "d")]) == [3]
    assert kept([]) == [1, 2, 3, 4, 5]


def test_verify(spark):
    expected = spark.createDataFrame([(22, at(100), 5), (23, at(100), 5), (24, at(100), 5)], "sid long, since timestamp, wait_seconds int")
    line = lambda sid, t: f"{t} [1:{sid}:1] 10:22:33"
    rows = [(1, 22, at(100)), (2, 23, at(103)), (3, 23, at(102)), (4, 24, at(106)), (5, 9, at(104))]
    alerts = spark.createDataFrame([(p, s, t, line(s, p)) for p, s, t in rows], "pos int, sid long, event_ts timestamp, line string")
    got = {r["sid"]: (r["passed"], r["first_line"]) for r in joins.verify_rules(expected, alerts).collect()}
    assert got == {22: (False, None), 23: (True, line(23, 2)), 24: (False, None)}
    # The raw mode also finds the number inside a clock time.
    raw = {r["sid"]: r["passed"] for r in joins.verify_rules(expected, alerts, "raw").collect()}
    assert raw == {22: True, 23: True, 24: False}
    failed = joins.verify_rules(expected, alerts).where("NOT passed")
    lines = joins.new_lines(failed, alerts).collect()
    assert sorted((r["expected_sid"], r["pos"]) for r in lines) == [(s, p) for s in (22, 24) for p in (2, 3, 5)]


def test_lines_of_failed_rules_are_stored_once(spark):
    """A thousand overlapping windows over the same lines: as many rows as lines, and one range per rule."""
    expected = spark.createDataFrame([(k, at(k % 50), 10 + k % 7) for k in range(1000)] + [(9, at(5), 0)], "sid long, since timestamp, wait_seconds int")
    rows = [(p, at(p / 2), f"l{p}") for p in range(-5, 200)] + [(999, None, "no time")]
    alerts = spark.createDataFrame(rows, "pos int, event_ts timestamp, line string").withColumn("piece_of", F.lit("kept"))
    lines, ranges = joins.windows_in_pieces(expected, alerts)
    kept = {r.pos: r.piece for r in lines.collect()}
    assert lines.count() == len(kept) == sum(any(k % 50 < p / 2 <= k % 50 + 10 + k % 7 for k in range(1000)) for p in range(-5, 200))
    assert ranges.count() == 1000
    got = {(r.expected_sid, r.pos) for r in joins.expand_lines(lines, ranges).collect()}
    assert got == {(k, p) for k in range(1000) for p in range(-5, 200) if k % 50 < p / 2 <= k % 50 + 10 + k % 7}


def test_suggestion_text_with_preamble(spark, tmp_path):
    mark = suggestions.MARKER
    (tmp_path / "s.txt").write_text(f"my notes\n{mark}\nalert tcp (a;)\n\n{mark}\n\n{mark}\nbash\nalert tcp (b;)\n\n")
    (tmp_path / "t.txt").write_text(f"{mark}\ndrop tcp (c;)\n\n")
    got = suggestions.read_suggestions(spark, str(tmp_path)).collect()
    assert sorted(r["body"] for r in got) == ["alert tcp (a;)", "bash\nalert tcp (b;)", "drop tcp (c;)"]


def test_mined_export_order(spark, tmp_path):
    df = spark.createDataFrame([(k, f"m{k}", f"alert {k}") for k in range(50)], "sid long, message string, rule string")
    path = str(tmp_path / "mined")
    assert suggestions.write_mined_rules(df, path, "alerts.csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "mined").glob("part-*")))
    assert text.startswith("# AI-Mined Snort Rules\n# Generated from alerts.csv analysis\n")
    assert [l for l in text.splitlines() if l.startswith("alert")] == [f"alert {k}" for k in range(50)]
    assert not suggestions.write_mined_rules(df.limit(0), str(tmp_path / "none"), "x")


def test_same_rule_gets_one_number(spark):
    answers = [(1, HEAD + "; sid:5; rev:1;)"), (2, HEAD + "; sid: 6; rev:2;)"), (3, HEAD.replace("y", "z") + ")"), (4, "no rule")]
    df = spark.createDataFrame(answers, "prompt_id long, response string")
    got = jobs.packet_suggestions(df, 500)
    assert sorted(r["sid"] for r in got.collect()) == [500, 501]
    assert jobs.packet_suggestions(df, 500, got.select("rule_key")).count() == 0


def test_event_filter_plan_cuts_ranks_early(spark):
    df = spark.createDataFrame([(1, 1, "s", at(0))], "gid int, sid long, src_ip string, event_ts timestamp")
    plan = thresholds.event_filter(df, 1, 1, "limit", "src_ip", 2, 60)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    with pytest.raises(ValueError):
        thresholds.event_filter(df, 1, 1, "x", "src_ip", 2, 60)


def test_rules_that_cannot_be_judged(spark):
    texts = [
        'alert tcp any any -> any [80,443] (msg:"a"; sid:1;)', 'alert tcp any any -> any 1:1024 (msg:"a"; sid:2;)', 'alert tcp any any <> any 80 (msg:"a"; sid:3;)',
        'alert tcp any any -> any 80 (content:!"abc"; sid:4;)', 'alert tcp any any -> any 80 (detection_filter: track by_src, count 2; sid:5;)',
        'alert tcp any any -> $OTHER_NET 80 (msg:"a"; sid:6;)', 'alert tcp any any -> 10.0.0.0/33 80 (msg:"a"; sid:9;)', 'alert ip $EXTERNAL_NET any -> any any (msg:"a"; sid:7;)', 'alert tcp 10.9.9.9 any -> any 80 (msg:"a"; sid:8;)',
    ]
    table = rules_io.rules_from_lines(spark.createDataFrame([(t,) for t in texts], "value string"))
    reasons = {r.sid: r.reason for r in joins.unusable_rules(table).collect()}
    assert reasons == {
        1: "port list or range", 2: "port list or range", 3: "both directions", 4: "negated content", 5: "incomplete threshold", 6: "unknown network", 9: "unknown network"
    }
    packets = spark.createDataFrame(
        [(1, "tcp", "10.9.9.9", 5, "1.2.3.4", 80), (2, "tcp", "10.9.9.8", 5, "1.2.3.4", 80), (3, "udp", "10.0.0.1", 5, "1.2.3.4", 9)],
        "packet_id long, protocol string, src_ip string, src_port int, dst_ip string, dst_port int",
    ).selectExpr("*", "cast('' as binary) payload", "'PA' tcp_flags", "0 itype", "0 icode", "true to_server", "true established")
    assert sorted((r.packet_id, r.sid) for r in joins.match_rules(packets, table).collect()) == [(1, 7), (1, 8), (2, 7), (3, 7)]


def test_suppression_entries(spark):
    alerts = spark.createDataFrame([(1, 5, f"10.0.0.{k}", "d") for k in range(4)], "gid long, sid long, source_ip string, dest_ip string")
    odd = [(1, 5, f"odd{k}", "10.0.0.1") for k in range(14)] + [(1, 5, None, "10.0.0.2"), (1, 5, " BY_SRC ", "10.0.0.3")]
    listed = spark.createDataFrame(odd, "gid long, sid long, track string, ip string")
    assert sorted(r.source_ip[-1] for r in joins.suppress(alerts, listed).collect()) == ["0", "1", "2"]
    assert joins.bad_suppressions(listed).count() == 15


def test_many_thresholds_in_one_plan(spark):
    rows = [(k, k % 500, "s" if k % 3 else None, "d", f"2024-01-01 00:00:{k // 500:02d}", 1 + k % 4, 1 + k % 5 * 3, "by_src" if k % 2 else "by_dst") for k in range(10_000)]
    df = spark.createDataFrame(rows, "id long, sid long, src_ip string, dst_ip string, ts string, df_count int, df_seconds int, df_track string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id for r in thresholds.detection_filters(df).collect()}
    want = set()
    for k, sid, src, dst, ts, count, seconds, track in rows:
        who, t = (dst if track == "by_dst" else src), int(ts[-2:])
        same = [r for r in rows[sid::500] if (r[3] if track == "by_dst" else r[2]) == who and r[7] == track]
        if sum(t - seconds < int(r[4][-2:]) <= t for r in same) >= count:
            want.add(k)
    assert got == want


PACKET = "packet_id long, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, payload string, tcp_flags string, itype int, icode int, to_server boolean, established boolean"


def packet_table(spark, rows):
    return spark.createDataFrame(rows, PACKET).withColumn("payload", F.col("payload").cast("binary"))


def test_rules_fail_closed(spark):
    """Whatever a rule holds beside what matching evaluates, it is listed with a reason and matches nothing."""
    odd = {
        'pcre:"/evil/"': "option pcre", "flow:to_client": "flow", "flow:established,stateless": "flow", "flow": "flow", "dsize:>1000": "option dsize",
        'content:"GET",offset 500': "content form", 'content:"GET"; offset:500': "option offset", 'content:"GET"; nocase': "option nocase", "itype:>10": "itype", "icode:1:5": "icode",
        'content:"|47 45 54|"': "content form", "content:GET": "content form", 'content:"a\\|b"': "content form", 'content:""': "content form", 'content:! "GET"': "negated content", "flags:+F": "flags", "flags:F,x": "flags",
        "flags:F; flags:S": "repeated flags", "rev:x": "rev", "detection_filter: track by_src, count 2, seconds 0": "threshold", "detection_filter: track by_src, count 2": "incomplete threshold",
        "detection_filter: track by_src, count 2, seconds 5, apply x": "threshold", "detection_filter: track by_src, count 99999999999, seconds 5": "threshold", "gid:3": "option gid", "itype:": "itype", 'msg:"a" extra "': "unreadable options",
    }
    lines = [(f"alert tcp any any -> any 80 ({o}; sid:{k};)",) for k, o in enumerate(odd)]
    more = [("log tcp any any -> any 80 (sid:100;)", "action"), ("alert ssl any any -> any 80 (sid:101;)", "protocol"), ("alert tcp any any -> any 80 (sid:1x;)", "sid"), ("alert tcp any any -> any 80 (rev:1 sid:103)", "unreadable options")]
    table = rules_io.rules_from_lines(spark.createDataFrame(lines + [(r,) for r, _ in more], "value string"))
    listed = {r.rule_text: r.reason for r in joins.unusable_rules(table).collect()}
    assert [listed.get(x[0]) for x in lines] == list(odd.values()) and [listed.get(r) for r, _ in more] == [x for _, x in more]
    packets = packet_table(spark, [(1, "tcp", "1.1.1.1", 5, "2.2.2.2", 80, "GET / HTTP", "F", None, None, True, True), (2, "icmp", "1.1.1.1", 5, "2.2.2.2", 80, "GET evil", None, 3, 1, True, True)])
    assert joins.match_rules(packets, table).count() == 0
    unread = rules_io.unread_lines(spark.createDataFrame([("alert http (msg:1)",), ("# alert x",), ("include y",), ('alert tcp any any -> any any (msg:"x";)',)], "value string"))
    assert [tuple(r) for r in unread.collect()] == [("alert http (msg:1)", "unreadable header")]


def test_whole_rules_still_match(spark):
    lines = [
        'alert tcp any any -> any any (flags:AP; sid:1;)', 'drop tcp any any -> any any (flags:PA,12; sid:2;)', 'alert tcp any any -> any any (content:"a\\\\b\\;"; sid:3;)',
        'alert tcp any any -> any any (content:"GET", fast_pattern , nocase; metadata:a b, c d; reference:url,x; sid:4;)', 'alert tcp any any -> any any (content:"get"; fast_pattern; classtype:x; sid:5;)',
    ]
    table = rules_io.rules_from_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.sid, r.reason) for r in joins.unusable_rules(table).collect()) == []
    packets = packet_table(spark, [(1, "tcp", "1.1.1.1", 5, "2.2.2.2", 80, "gEt a\\b;", "PA", None, None, True, True), (2, "tcp", "1.1.1.1", 5, "2.2.2.2", 80, "", "P", None, None, True, True)])
    assert sorted((r.packet_id, r.sid) for r in joins.match_rules(packets, table).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_fifty_thousand_rules(spark, sf, monkeypatch):
    """Many rules are found by their grams: equal to a test of every pair, with few candidates."""
    words = [r.w for r in inputs.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("length(w) >= 6 AND NOT w RLIKE '[^a-z]'").distinct().orderBy("w").limit(40).collect()]
    texts = [f"{words[k % 40]} {words[k * 7 % 40]}" if k % 1000 == 0 else f"rare{k} {words[k % 40]}" for k in range(50_000)]
    rules = spark.createDataFrame([(f'alert tcp any any -> any any (content:"{t}"{", nocase" if k % 2 else ""}; sid:{k};)',) for k, t in enumerate(texts)], "value string")
    held = [f"x {texts[1000 * k]} RARE{k * 77} {words[k * 77 % 40]} {texts[k * 77].upper()} \u0130\u03a3 {texts[k * 13]}" for k in range(40)] + ["", "abc", "\u00e9" * 40]
    packets = packet_table(spark, [(k, "tcp", "1.1.1.1", 5, "2.2.2.2", 80, t, None, None, None, True, True) for k, t in enumerate(held)])
    table = rules_io.rules_from_lines(rules)
    got = sorted((r.packet_id, r.sid) for r in joins.match_rules(packets, table).collect())
    want = sorted((p, k) for p, t in enumerate(held) for k, c in enumerate(texts) if (c.lower() in t.lower() if k % 2 else c in t))
    assert got == want and len(want) > 80
    monkeypatch.setattr(joins, "LOOK_AT", 1)
    usable = joins._rule_grams(joins._resolved(table, joins.HOME_NET))
    probes = joins.gram_probes(packets.withColumn("_text", F.col("payload").cast("string")))
    candidates = probes.join(joins.gram_index(packets, usable), F.col("_gram") == F.col("r_gram")).count()
    assert len(want) <= candidates < len(held) * 50_000 / 50


def test_grams_lose_no_match(spark, sf, monkeypatch):
    packets, rules = inputs.packets(spark, sf), inputs.rules(spark)
    pairs = lambda df: sorted((r["packet_id"], r["sid"]) for r in df.select("packet_id", "sid").collect())
    plain = pairs(joins.match_rules(packets, rules))
    monkeypatch.setattr(joins, "INDEX_FROM", 1)
    assert pairs(joins.match_rules(packets, rules)) == plain and plain


def test_copies_of_a_large_rule_table_are_not_broadcast(spark, sf, monkeypatch):
    """Files of rules are far smaller than their salted copies, so what Spark makes of the files must not decide."""
    packets, rules = inputs.packets(spark, sf), inputs.rules(spark)
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    plan = joins._looked_up(
        packets.withColumns({"_text": F.col("payload").cast("string"), "_dst": F.lit(1), "_src": F.lit(1)}), joins.settle(joins._resolved(rules, joins.HOME_NET)),
        F.col("protocol") == F.col("r_proto"), F.lit(True), 4,
    )._jdf.queryExecution().executedPlan().toString()
    assert [word for word in plan.replace("(", " ").split() if word.endswith("Join")][0] == "SortMergeJoin"


def test_many_rules_are_found_by_their_heads(spark, monkeypatch):
    """Networks of all sizes on both sides, ports, protocols and contents too short or foreign for a gram: equal to a test of every pair."""
    nets = ["any", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3", "0.0.0.0/0", "$HOME_NET", "172.16.0.0/12"]
    contents = ["", 'content:"ab"; ', 'content:"ééééé"; ', 'content:"evil word", nocase; ', 'content:"odd!"; ', "flags:S; "]
    lines = [
        f"alert {('tcp', 'udp', 'ip')[k % 3]} {nets[k % 8]} any -> {nets[k * 5 // 8 % 8]} {('any', '80', '53')[k // 7 % 3]} ({contents[k // 3 % 6]}sid:{k};)" for k in range(600)
    ]
    table = rules_io.rules_from_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    ips = ["10.1.2.3", "10.1.2.9", "10.9.9.9", "192.168.1.7", "8.8.8.8", None, "no address"]
    texts = ["cab EVIL word", "odd!", "ÉÉÉÉÉ ééééé", "", None, "evil word odd! ab"]
    rows = [(k % 90, ("tcp", "udp", "icmp", None)[k % 4], ips[k % 7], 5, ips[k // 7 % 7], (80, 53, None)[k // 5 % 3], texts[k // 3 % 6], ("S", None)[k % 2], None, None, True, True) for k in range(300)]
    packets = packet_table(spark, rows)
    pairs = lambda: sorted((r.packet_id, r.sid) for r in joins.match_rules(packets, table).collect())
    by_heads = pairs()
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    monkeypatch.setattr(joins, "GRAMS", 1)
    assert pairs() == by_heads
    monkeypatch.undo()
    monkeypatch.setattr(joins, "INDEX_FROM", 10**9)
    assert pairs() == by_heads and len(by_heads) > 500


def test_an_index_too_large_to_broadcast_goes_out_in_shares(spark, monkeypatch):
    """No payload is shuffled however many the rules are; equal packets keep all their matches."""
    lines = [f'alert {("tcp", "ip")[k % 2]} any any -> any any (content:"{("common", f"rare{k % 90}", "two words")[k % 3]}"{", nocase" if k % 4 else ""}; sid:{k};)' for k in range(400)]
    table = rules_io.rules_from_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    texts = ["a COMMON word", "common RARE7 two words", "rare10 rare13", "", None, "nothing"]
    rows = [(k % 7 or None, ("tcp", "udp", None)[k % 3], "1.1.1.1", 5, None, 80, texts[k % 6], None, None, None, True, True) for k in range(60)]
    packets = packet_table(spark, rows)
    pairs = lambda df: sorted((r.packet_id or 0, r.sid, r.payload) for r in df.collect())
    whole = pairs(joins.match_rules(packets, table))
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(joins, "SAME", 20)
    two = joins.match_rules(packets, table)
    assert "SortMergeJoin" not in two._jdf.queryExecution().executedPlan().toString() and pairs(two) == whole and len(whole) > 1000
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 40)
    monkeypatch.setattr(joins, "GRAMS", 40)
    assert pairs(joins.match_rules(packets, table)) == whole


def test_rules_of_networks_that_no_packet_has_cost_no_look_at_a_payload(spark, monkeypatch):
    lines = [(f'alert tcp 9.9.9.9 any -> any any (content:" the "; sid:{k};)',) for k in range(300)]
    table = rules_io.rules_from_lines(spark.createDataFrame(lines, "value string"))
    packets = packet_table(spark, [(1, "tcp", "1.1.1.1", 5, "2.2.2.2", 80, "all the words", None, None, None, True, True)])
    monkeypatch.setattr(joins, "gram_probes", None)
    assert joins.match_rules(packets, table).count() == 0
