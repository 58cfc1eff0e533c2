"""Rule matching, suppression, decisions, verification and service tags."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.grams import grams_of_contents, grams_of_texts
from alertloom.functions.network import NETWORK, cidr_bounds, ip_number
from alertloom.operators.numbering import number_rows, running_totals
from alertloom.operators.sampling import content_digest
from alertloom.runtime import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, is_small, measured_size, settle

HOME_NET = {"HOME_NET": "192.168.1.0/24", "EXTERNAL_NET": "any"}
#: The protocols that a rule for ``ip`` covers.
IP_PROTOCOLS = ("tcp", "udp", "icmp")
ANY_PORT = -1
SALTS = 64
#: Rules from which they are found by their heads and grams.
INDEX_FROM = 256
#: Grams that one pass over the packets looks for.
GRAMS = 1 << 20
#: One packet in so many is looked at to learn which grams are rare; the choice changes no match.
LOOK_AT = 16
#: Shares of the rules' index that one plan may broadcast.
AT_ONCE = 2
#: Rules that ask for the same and share a test, about.
SAME = 512
#: What rules read of a packet.
LOOKED_AT = ("protocol", "src_ip", "src_port", "dst_ip", "dst_port", "payload", "tcp_flags", "itype", "icode", "to_server", "established")


def _network(side: str, variables: dict[str, str]) -> Column:
    """The rule's network with variables replaced."""
    net = F.col(side)
    for name, value in variables.items():
        net = F.when(F.col(side) == f"${name}", F.lit(value)).otherwise(net)
    return net


def _is_address(net: Column) -> Column:
    return net.rlike(NETWORK)


def _with_reason(rules: DataFrame, variables: dict[str, str]) -> DataFrame:
    """Rules with both sides and ``_reason``, why a rule cannot be matched; a table without source columns means any."""
    missing = {c: F.lit("any") for c in ("src_net", "src_port") if c not in rules.columns}
    rules = rules.withColumns(missing) if missing else rules
    known = lambda side: _is_address(_network(side, variables)) | (_network(side, variables) == "any")
    given = F.col("reject_reason") if "reject_reason" in rules.columns else F.lit(None).cast("string")
    strange = F.when(~F.coalesce(known("src_net") & known("dst_net"), F.lit(False)), "unknown network")
    return rules.withColumn("_reason", F.coalesce(given, strange))


def unusable_rules(rules: DataFrame, variables: dict[str, str] | None = None) -> DataFrame:
    """Rules that :func:`match_rules` leaves out: (sid, rule_text, reason)."""
    return _with_reason(rules, variables or HOME_NET).where("_reason IS NOT NULL").select("sid", "rule_text", F.col("_reason").alias("reason"))


def _resolved(rules: DataFrame, variables: dict[str, str]) -> DataFrame:
    """Networks as number bounds (null = any), the port as a join key and one row per protocol; usable rules only."""
    usable = _with_reason(rules, variables).where("_reason IS NULL")
    bounds = lambda side: cidr_bounds(F.when(_is_address(_network(side, variables)), _network(side, variables)))
    (low, high), (src_low, src_high) = bounds("dst_net"), bounds("src_net")
    protocols = F.when(F.col("proto") == "ip", F.array(*map(F.lit, IP_PROTOCOLS))).otherwise(F.array("proto"))
    return usable.withColumn("proto", F.explode(protocols)).select(
        src_low.alias("r_src_low"), src_high.alias("r_src_high"), F.col("src_port").try_cast("int").alias("r_src_port"),
        F.col("sid").alias("r_sid"), F.col("rev").alias("r_rev"), F.col("msg").alias("r_msg"),
        F.col("proto").alias("r_proto"), F.coalesce(F.col("dst_port"), F.lit(ANY_PORT)).alias("r_port"),
        low.alias("r_low"), high.alias("r_high"),
        F.col("contents").alias("r_contents"), _letters(F.col("flags")).alias("r_flags"),
        F.col("itype").alias("r_itype"), F.col("icode").alias("r_icode"),
        F.coalesce(F.array_contains("flow", "to_server"), F.lit(False)).alias("r_to_server"),
        F.coalesce(F.array_contains("flow", "established"), F.lit(False)).alias("r_established"),
        F.col("df_track").alias("r_track"), F.col("df_count").alias("r_count"), F.col("df_seconds").alias("r_seconds"),
    )


def _letters(flags: Column) -> Column:
    """Flags in one order, as a set has none."""
    return F.array_join(F.array_sort(F.split(flags, "")), "")


def _rule_holds(lowered: Column | None = None) -> Column:
    """Everything but protocol and port. A null packet field never satisfies a test on it."""
    no = lambda c: F.coalesce(c, F.lit(False))
    wanted = lambda rule, packet: F.col(rule).isNull() | no(F.col(rule) == F.col(packet))
    in_net = F.col("r_low").isNull() | no(F.col("_dst").between(F.col("r_low"), F.col("r_high")))
    in_net &= F.col("r_src_low").isNull() | no(F.col("_src").between(F.col("r_src_low"), F.col("r_src_high")))
    # Without a column that holds it, lower case is made only where a rule asks for it and its header already fits.
    lowered = F.lower("_text") if lowered is None else lowered
    contents = F.forall(
        "r_contents",
        lambda c: no(
            F.when(c["nocase"], F.contains(lowered, F.lower(c["text"]))).otherwise(
                F.contains(F.col("_text"), c["text"])
            )
        ),
    )
    flow = (~F.col("r_to_server") | no(F.col("to_server"))) & (~F.col("r_established") | no(F.col("established")))
    flags = F.col("r_flags").isNull() | no(F.col("r_flags") == _letters(F.col("tcp_flags")))
    header = in_net & wanted("r_src_port", "src_port") & flags & wanted("r_itype", "itype") & wanted("r_icode", "icode") & flow
    return header & contents


def _rule_grams(table: DataFrame) -> DataFrame:
    """``r_grams``: the ASCII grams of a rule's longest content in lower case; empty if it has none.

    A lower-cased payload holds all of them if the payload holds the content in either way
    of matching: ASCII letters are lowered one by one whatever stands around them.
    """
    longest = F.get(F.array_sort("r_contents", lambda a, b: F.length(b["text"]) - F.length(a["text"])), F.lit(0))["text"]
    return table.withColumn("r_grams", grams_of_contents()(F.lower(longest).cast("binary")))


def _shares(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The rows in shares of about ``most`` rows, dealt by a hash of ``key``."""
    n = -(-rows.count() // most) or 1
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def _numbers(grams: DataFrame) -> np.ndarray:
    """The grams of a column; the caller bounds how many."""
    return grams.toArrow().column(0).to_numpy()


def gram_index(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (r_sid, r_grams, …) with ``r_rule``, a number, and ``r_gram``, the gram that the fewest packets hold of those that were looked at."""
    grams = settle(rules.select(F.explode("r_grams").alias("gram")).distinct(), "grams")
    some = packets.where(F.pmod(F.xxhash64("packet_id"), F.lit(LOOK_AT)) == 0).select(F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("_text"))
    shares = _shares(grams, "gram", GRAMS)
    some = settle(some, "looked-at") if len(shares) > 1 else some
    seen = [settle(gram_probes(some, _numbers(share)).groupBy(F.col("_gram").alias("gram")).agg(F.count(F.lit(1)).alias("n")), "gram-counts") for share in shares]
    counts = reduce(DataFrame.unionByName, seen)
    numbered = settle(rules.withColumn("r_rule", F.monotonically_increasing_id()), "rules")
    each = numbered.select("r_rule", F.explode("r_grams").alias("gram")).join(broadcast_if_small(counts), "gram", "left")
    rarest = each.groupBy("r_rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("one")).select("r_rule", F.col("one.gram").alias("r_gram"))
    return numbered.join(rarest, "r_rule")


def gram_probes(packets: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """One row per packet and distinct gram of its lower-cased payload ``_text``; with ``wanted`` those grams only.

    ``_lower`` is made once for a packet, as its grams and all tests of its rules read it.
    """
    lowered = packets.withColumn("_lower", F.lower("_text"))
    return lowered.withColumn("_gram", F.explode(grams_of_texts(wanted)(F.col("_lower").cast("binary"))))


def _tests(index: DataFrame, shown: list[str]) -> DataFrame:
    """One row per ``SAME`` rules that ask for the same, with their columns ``shown`` as the list ``r_same``; ``r_test`` numbers the rows.

    What many rules ask for is then tested once for a packet.
    """
    asked = [c for c in index.columns if c not in (*shown, "r_rule", "r_grams", "r_head", "r_side", "r_size")]
    text = F.transform("r_contents", lambda c: F.concat(F.coalesce(F.hex(F.encode(c["text"], "UTF-8")), F.lit("n")), F.coalesce(c["nocase"].cast("string"), F.lit("n"))))
    keyed = settle(index.withColumn("_contents", F.array_join(text, ",")).withColumn("_asked", content_digest([*[c for c in asked if c != "r_contents"], "_contents"])).drop("_contents"), "asked")
    counts = keyed.groupBy("_asked").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SAME)
    dealt = keyed.join(broadcast_if_small(counts), "_asked", "left").withColumn("_deal", F.pmod(F.xxhash64("r_rule"), F.coalesce(F.ceil(F.col("_n") / SAME), F.lit(1))))
    one = dealt.groupBy("_asked", "_deal").agg(*[F.any_value(c).alias(c) for c in asked], F.collect_list(F.struct(*shown)).alias("r_same"))
    return settle(one.drop("_asked", "_deal").withColumn("r_test", F.monotonically_increasing_id()), "index")


def _with_head(table: DataFrame) -> DataFrame:
    """``r_head``, a digest of protocol, port and the narrower of the two networks; ``r_side`` and ``r_size`` say which one.

    A size is a power of two, so all rules together have at most 134 shapes of a head.
    """
    size = lambda low, high: F.col(high) - F.col(low) + 1
    dst, src = size("r_low", "r_high"), size("r_src_low", "r_src_high")
    side = F.when(dst.isNotNull() & (src.isNull() | (dst <= src)), "_dst").when(src.isNotNull(), "_src").otherwise("")
    by = lambda d, s: F.when(F.col("r_side") == "_dst", d).when(F.col("r_side") == "_src", s).otherwise(F.lit(0).cast("long"))
    sided = table.withColumn("r_side", side).withColumn("r_size", by(dst, src))
    return sided.withColumn("r_head", F.xxhash64("r_proto", F.col("r_port").cast("int"), "r_side", "r_size", by(F.col("r_low"), F.col("r_src_low"))))


def _heads(probes: DataFrame, shapes: list, port: Column) -> DataFrame:
    """``_heads``: the heads of all rules that could be for a packet, one of each shape that the rules have."""
    heads = []
    for shape in shapes:
        of_port = F.lit(ANY_PORT) if shape["any_port"] else port
        net = F.col(shape["r_side"]) - F.col(shape["r_side"]) % shape["r_size"] if shape["r_side"] else F.lit(0).cast("long")
        head = F.xxhash64("protocol", of_port.cast("int"), F.lit(shape["r_side"]), F.lit(shape["r_size"]).cast("long"), net)
        heads.append(F.when(net.isNotNull(), head))
    return probes.withColumn("_heads", F.array_distinct(F.array_compact(F.array(*heads))))


def match_rules(packets: DataFrame, rules: DataFrame, variables: dict[str, str] | None = None, salts: int = SALTS) -> DataFrame:
    """One row per packet and rule that matches it.

    Packets look up the rules of their own port and the any-port rules, so the
    join is an equi-join on (protocol, port). Rules below the checked size are
    broadcast and the packets never move. A larger rule table is copied over
    ``salts`` values and both sides shuffle on (protocol, port, salt), because
    the any-port keys alone could hold every packet.

    From ``INDEX_FROM`` rules on the key is a rule's head: protocol, port and the narrower network.
    Rules whose head no packet has are left out. Where a rule has a content, one gram of it is part of the
    key: a packet's grams and heads meet the index by an equi-join, and the whole rule is
    tested on the few that meet, once for all rules that ask for the same. An index too large to be broadcast goes out in shares, each with a
    pass over the packets, so payloads are never shuffled. Beyond ``AT_ONCE`` shares each one's matches
    are written by a digest of what rules read of a packet, so that one share is held at a time.
    """
    table = settle(_resolved(rules, variables or HOME_NET), "rules")
    text = F.col("payload").cast("string")
    probes = packets.withColumns({"_text": F.coalesce(text, F.lit("")), "_dst": ip_number(F.col("dst_ip")), "_src": ip_number(F.col("src_ip"))})
    port = F.coalesce(F.col("dst_port"), F.lit(ANY_PORT - 1))
    renamed = {
        "sid": "r_sid", "rev": "r_rev", "msg": "r_msg",
        "df_track": "r_track", "df_count": "r_count", "df_seconds": "r_seconds",
    }
    shown = lambda met: met.select(*packets.columns, *[F.col(old).alias(new) for new, old in renamed.items()])
    if table.count() < INDEX_FROM:
        probes = probes.withColumn("_port", F.explode(F.array(port, F.lit(ANY_PORT))))
        on = (F.col("protocol") == F.col("r_proto")) & (F.col("_port") == F.col("r_port"))
        return shown(_looked_up(probes, table, on, _rule_holds(), salts))

    table = _with_head(table)
    shapes = table.select((F.col("r_port") == ANY_PORT).alias("any_port"), "r_side", "r_size").distinct().collect()
    probes = _heads(probes, shapes, port)
    # Both sides of this are digests; what no packet has is not worth a look at a payload.
    met = settle(probes.select(F.explode("_heads").alias("r_head")).distinct().join(table.select("r_head").distinct(), "r_head", "left_semi"), "heads")
    table = settle(_rule_grams(table.join(broadcast_if_small(met), "r_head", "left_semi")), "rules")
    whole = (F.col("protocol") == F.col("r_proto")) & ((F.col("r_port") == ANY_PORT) | (F.col("r_port") == port))
    headed = lambda rows: rows.withColumn("_head", F.explode("_heads"))
    plain, with_gram = table.where(F.size("r_grams") == 0), table.where(F.size("r_grams") > 0)
    found = []
    if not with_gram.isEmpty():
        index = _tests(gram_index(packets, with_gram).withColumn("r_key", F.xxhash64("r_gram", "r_head")), list(renamed.values()))
        rows, size = measured_size(index)
        shares = _shares(index, "r_test", max(1, min(BROADCAST_ROWS, rows * BROADCAST_BYTES // max(size, 1))))
        # Payloads stay where they are: every share of the rules goes to them.
        probes = probes.withColumn("_look", content_digest(list(LOOKED_AT))) if len(shares) > AT_ONCE else probes
        each = lambda met: shown(met.select("*", F.explode("r_same").alias("_rule")).select(*packets.columns, "_rule.*"))
        for share in shares:
            keyed = headed(gram_probes(probes, _numbers(share.select("r_gram").distinct()))).withColumn("_key", F.xxhash64("_gram", "_head"))
            on = (F.col("_key") == F.col("r_key")) & (F.col("_gram") == F.col("r_gram")) & whole & _rule_holds(F.col("_lower"))
            met = keyed.join(F.broadcast(share), on, "inner")
            found.append(each(met) if len(shares) <= AT_ONCE else settle(met.select("_look", "r_test").distinct(), "matches"))
        if len(shares) > AT_ONCE:
            # Packets that look alike to every rule have the same matches.
            matches = reduce(DataFrame.unionByName, found).join(index.select("r_test", "r_same"), "r_test").hint("merge")
            found = [each(probes.join(matches, "_look"))]
    if not found or not plain.isEmpty():
        found.append(shown(_looked_up(headed(probes), plain, F.col("_head") == F.col("r_head"), whole & _rule_holds(), salts)))
    return reduce(DataFrame.unionByName, found)


def _looked_up(probes: DataFrame, table: DataFrame, on: Column, holds: Column, salts: int) -> DataFrame:
    """Probes with the rules of their key that hold."""
    if is_small(table):
        return probes.join(F.broadcast(table), on & holds, "inner")
    # The files of the rules are far smaller than their copies, so Spark must not judge by them what to broadcast.
    copies = table.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salted = probes.withColumn("_salt", F.pmod(F.xxhash64("packet_id"), F.lit(salts)).cast("int"))
    return salted.join(copies, on & (F.col("_salt") == F.col("r_salt")) & holds, "inner")


def _side(track: str):
    """by_src or by_dst, however it is spaced or cased; null for anything else."""
    name = F.lower(F.trim(F.col(track)))
    return F.when(name.isin("by_src", "by_dst"), name)


def bad_suppressions(suppressions: DataFrame) -> DataFrame:
    """Entries that name an address without a side, with the reason."""
    reason = F.when(F.col("track").isNull(), "address without track").otherwise("unknown track")
    return suppressions.where(F.col("ip").isNotNull() & _side("track").isNull()).withColumn("reject_reason", reason)


def suppress(alerts: DataFrame, suppressions: DataFrame, source: str = "source_ip", dest: str = "dest_ip") -> DataFrame:
    """Drop alerts named by (gid, sid), by (gid, sid, tracked address) or by tracked address.

    A null in the list means any. Each form that the list holds is one anti-join
    on plain keys; no form needs a nested loop. Entries that name an address without
    saying which side it stands on do nothing; :func:`bad_suppressions` lists them.
    """
    has = lambda c: F.col(c).isNotNull()
    suppressions = suppressions.withColumn("track", _side("track")).where(~has("ip") | has("track"))
    tracked = F.when(has("ip"), F.col("track"))
    form_of = [has("gid").alias("gid"), has("sid").alias("sid"), tracked.alias("ip")]
    forms = suppressions.groupBy(*form_of).agg(F.count(F.lit(1)).alias("n"))
    out = alerts
    # No more than twelve can exist: with or without gid and sid, times no address, by_src, by_dst.
    for form in sorted(forms.collect(), key=str):
        keys = {k: F.col(k) for k in ("gid", "sid") if form[k]}
        if form["ip"]:
            keys[dest if form["ip"] == "by_dst" else source] = F.col("ip")
        if not keys:
            continue
        rows = suppressions.where(
            (has("gid") == F.lit(form["gid"])) & (has("sid") == F.lit(form["sid"])) & tracked.eqNullSafe(F.lit(form["ip"]))
        )
        listed = rows.select(*[c.alias(f"_{k}") for k, c in keys.items()])
        listed = F.broadcast(listed) if form["n"] <= BROADCAST_ROWS else listed
        condition = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys])
        out = out.join(listed, condition, "left_anti")
    return out


def apply_decisions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions that a person approved."""
    yes = decisions.where(F.lower(F.trim("decision")) == "y").select("suggestion_id")
    return suggestions.join(yes, "suggestion_id", "left_semi")


def undecided(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    return suggestions.join(decisions.select("suggestion_id"), "suggestion_id", "left_anti")


def alerts_in_wait(expected: DataFrame, alerts: DataFrame, mode: str = "parsed") -> DataFrame:
    """Alerts of the expected rules inside (since, since + wait].

    ``parsed`` compares the rule number; ``raw`` looks for ``:sid:`` anywhere in
    the line, so it also finds it inside a clock time.
    """
    window = (F.col("event_ts") > F.col("since")) & (
        F.col("event_ts") <= F.col("since") + F.make_dt_interval(secs=F.col("wait_seconds"))
    )
    rules = expected.select(F.col("sid").alias("expected_sid"), "since", "wait_seconds").distinct()
    if mode == "raw":
        # Every digit run between colons is a key, so the lookup stays an equi-join.
        runs = F.array_distinct(F.regexp_extract_all("line", F.lit(r":(?=(\d+):)"), 1))
        keyed = alerts.withColumn("_key", F.explode(runs)).withColumn("_key", F.col("_key").try_cast("long"))
    else:
        keyed = alerts.withColumn("_key", F.col("sid"))
    return keyed.join(broadcast_if_small(rules), (F.col("_key") == F.col("expected_sid")) & window).drop("_key")


def verify_rules(expected: DataFrame, alerts: DataFrame, mode: str = "parsed") -> DataFrame:
    """Per expected rule: did it fire in its window, and with which line first.

    ``expected`` has (sid, since, wait_seconds), ``alerts`` (sid, event_ts, line, pos).
    """
    first = (
        alerts_in_wait(expected, alerts, mode)
        .groupBy("expected_sid", "since", "wait_seconds")
        .agg(F.min_by("line", "pos").alias("first_line"))
        .withColumnRenamed("expected_sid", "sid")
    )
    keys = ["sid", "since", "wait_seconds"]
    return (
        expected.select(*keys).distinct().join(first, keys, "left")
        .select(*keys, F.col("first_line").isNotNull().alias("passed"), "first_line")
    )


def windows_in_pieces(expected: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, ranges): what arrived in any window (since, since + wait] of the expected rules, each line once.

    The windows' bounds cut time into disjoint pieces, numbered in the order of time. A line
    gets the piece it lies in, and a rule the first and last piece of its window, so nothing
    is as large as lines times rules. ``lines`` are the alerts with ``piece``, ``ranges`` is (expected_sid, since,
    first_piece, last_piece); :func:`expand_lines` puts them together.

    Bounds and lines are sorted together, and two running totals tell a line how many
    bounds lie before it and how many windows are open there.
    """
    until = F.col("since") + F.make_dt_interval(secs=F.col("wait_seconds"))
    windows = settle(expected.select("sid", "since", until.alias("_until")).distinct(), "windows")
    ends = windows.select(F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("_until").alias("at"), F.lit(-1).alias("opens")))).alias("e"))
    bounds = settle(ends.select("e.*").groupBy("at").agg(F.sum("opens").alias("opens")), "bounds")
    numbered = number_rows(bounds, ["at"], 1, "piece").select("at", "piece")
    by = lambda c, name: numbered.select(F.col("at").alias(c), F.col("piece").alias(name))
    ranges = windows.join(by("since", "first_piece"), "since").join(by("_until", "_after"), "_until").where("first_piece < _after")
    ranges = ranges.select(F.col("sid").alias("expected_sid"), "since", "first_piece", (F.col("_after") - 1).alias("last_piece"))

    columns = [F.col(f"`{c}`") for c in alerts.columns]
    placed = alerts.select(F.struct(*columns).alias("_row"), F.col("event_ts").alias("_at_ts"), F.lit(0).alias("_bound"), F.lit(0).cast("long").alias("_opens"))
    marks = bounds.select(F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"), F.col("at").alias("_at_ts"), F.lit(1).alias("_bound"), F.col("opens").alias("_opens"))
    # A window leaves out its start and holds its end, so of one instant the lines come first.
    totals = running_totals(placed.where("_at_ts IS NOT NULL").unionByName(marks), ["_at_ts", "_bound", "_row"], {"piece": "_bound", "_open": "_opens"})
    return totals.where("_bound = 0 AND _open > 0").select("_row.*", "piece"), ranges


def expand_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per rule and line in its window; for the few rules that someone looks at."""
    pieces = ranges.withColumn("piece", F.explode(F.sequence("first_piece", "last_piece"))).select("expected_sid", "since", "piece")
    return lines.join(broadcast_if_small(pieces), "piece").drop("piece")


def new_lines(expected_failed: DataFrame, alerts: DataFrame) -> DataFrame:
    """What arrived in the window (since, since + wait] of each rule that did not fire."""
    lines, ranges = windows_in_pieces(expected_failed, alerts.select("event_ts", "line", "pos"))
    return expand_lines(lines, ranges).select("expected_sid", "since", "line", "pos")


def tag_service(flows: DataFrame, bindings: DataFrame, protocol: str = "protocol", port: str = "dst_port") -> DataFrame:
    """Add the service bound to (protocol, port), null where none is."""
    listed = bindings.select(F.col("proto").alias("_proto"), F.explode(F.split(F.trim("ports"), r"\s+")).alias("_port"), "service")
    pairs = (
        listed.withColumn("_port", F.col("_port").try_cast("int"))
        .groupBy("_proto", "_port").agg(F.min("service").alias("service"))
    )
    hit = (F.col(protocol) == F.col("_proto")) & (F.col(port) == F.col("_port"))
    return flows.join(broadcast_if_small(pairs), hit, "left").drop("_proto", "_port")
