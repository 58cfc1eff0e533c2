"""Prompts, and the cleaning of rule texts that come back, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed values.
RULE_ACTIONS = ("alert", "log", "drop", "reject", "pass")
SID_OPTION = r"sid:\s*\d+;"
REV_OPTION = r"rev:\s*\d+;"
HELD = "\uFDD0"  # a noncharacter that holds the place of a number
PAYLOAD_MARK = "payload="
UNKNOWN_HINT = "unknown"

# Fixed value: the text sent for one distinct attack. {0} message, {1} port, {2} hint.
MINING_PROMPT = """
    You are a Snort 3 expert. Write a strict, production-ready Snort 3 rule to detect this specific type of attack found in our logs.
    
    ATTACK DETAILS:
    - Attack Name: "{0}"
    - Destination Port: {1}
    - Suspected Payload/Signature: "{2}"

    STRICT REQUIREMENTS:
    1. HEADER: Use 'alert tcp $EXTERNAL_NET any -> $HOME_NET {1}'.
    2. METADATA:
       - msg:"AI-MINED {0}"
       - flow:to_server,established
       - classtype:attempted-admin
       - sid:<generate_unique_id>
       - rev:1
    3. CONTENT: 
       - If a payload hint is provided (not "unknown"), use 'content:"<hint>"; fast_pattern;'.
       - If no payload hint, use specific flags (e.g., 'flags:S;') or flow options appropriate for the attack name.
    4. FORMAT: Output ONLY the raw rule line. No markdown, no explanations.

    CORRECT EXAMPLE:
    alert tcp $EXTERNAL_NET any -> $HOME_NET 80 (msg:"AI-MINED SQL Injection"; flow:to_server,established; content:"UNION SELECT"; fast_pattern; classtype:attempted-admin; sid:1000020; rev:1;)

    OUTPUT:
    """

# Fixed value: the text sent for one packet. {0} protocol, {1} port, {2} payload.
PACKET_PROMPT = """
    Write a valid Snort 3 rule to detect this specific payload.
    
    ATTACK DETAILS:
    - Protocol: {0}
    - Dest Port: {1}
    - Payload: "{2}"
    
    CRITICAL SYNTAX RULES:
    1. Start with: alert {0} any any -> $HOME_NET {1}
    2. OPEN parentheses "(" immediately after the port.
    3. Put ALL content matches, msg, and metadata INSIDE the parentheses.
    4. CLOSE parentheses ")" ONLY at the very end.
    5. Do NOT include explanations. Output the rule ONLY.
    
    Example format:
    alert tcp any any -> $HOME_NET 80 (msg:"Malicious Payload"; content:"union select"; sid:1000005; rev:1;)
    """


def fill(template: str, *values: Column) -> Column:
    """Concatenate a template with ``{i}`` slots and the columns that fill them."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at = [(rest.find(f"{{{i}}}"), i) for i in range(len(values)) if f"{{{i}}}" in rest]
        if not at:
            pieces.append(F.lit(rest))
            break
        start, i = min(at)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(values[i].cast("string"))
        rest = rest[start + 3:]
    return F.concat(*pieces)


def payload_hint(message: Column) -> Column:
    """Text between the first ``payload=`` and the next space or ``payload=``."""
    after = F.split(message, PAYLOAD_MARK)[1]
    return F.when(F.contains(message, F.lit(PAYLOAD_MARK)), F.split(after, " ")[0]).otherwise(F.lit(UNKNOWN_HINT))


def mining_prompt(message: Column, dest_port: Column, hint: Column) -> Column:
    return fill(MINING_PROMPT, message, F.coalesce(dest_port.cast("string"), F.lit("nan")), hint)


def packet_prompt(protocol: Column, dest_port: Column, payload: Column) -> Column:
    """The prompt shows the first 100 characters of the payload, quotes escaped, on one line."""
    shown = F.replace(F.replace(F.substring(payload, 1, 100), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    return fill(PACKET_PROMPT, protocol, dest_port, shown)


def _one_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sanitise_packet_rule(response: Column) -> Column:
    """Struct (rule, reject_reason) of a raw response; exactly one of the two is null."""

    def judge(rule: Column) -> Column:
        odd_quotes = (F.length(rule) - F.length(F.replace(rule, F.lit('"'), F.lit("")))) % 2 != 0
        reason = F.when(rule == "", F.lit("no rule")).when(odd_quotes, F.lit("unbalanced quotes"))
        return let(reason, lambda r: F.struct(F.when(r.isNull(), rule).alias("rule"), r.alias("reject_reason")))

    found = F.regexp_extract(_one_line(F.coalesce(response, F.lit(""))), r"(?d)(alert\s+.*\))", 1)
    return let(F.regexp_replace(found, r"(?<!;)\)\z", ";)"), judge)


def with_sid(rule: Column, sid: Column) -> Column:
    """Give a packet rule its number: replace the one it has, else add one at the end."""
    text = sid.cast("string")
    # Regular expressions only mark the places, so the number may be a column.
    replaced = F.replace(F.regexp_replace(rule, SID_OPTION, HELD), F.lit(HELD), F.concat(F.lit("sid:"), text, F.lit(";")))
    ending = F.concat(F.lit("; sid:"), text, F.lit("; rev:1;)"))
    added = F.replace(F.regexp_replace(rule, r"[;\s]*\)\z", HELD), F.lit(HELD), ending)
    return F.when(F.contains(rule, F.lit("sid:")), replaced).otherwise(added)


def without_identity(rule: Column) -> Column:
    """Rule text without its number and revision: the same rule gives the same text."""
    bare = F.regexp_replace(rule, r"(?<=[;(])\s*(?:sid|rev):\s*\d+;", "")
    return F.trim(_squeeze(F.regexp_replace(bare, r";[\s;]*;", ";")))


def sanitise_mined_rule(response: Column) -> Column:
    text = F.trim(F.replace(F.replace(response, F.lit("```"), F.lit("")), F.lit("snort"), F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)src ip \S+", ""), r"(?i)dst port \S+", "")
    return F.trim(_squeeze(text), F.lit(" \t\n\r\x0b\x0c"))


def is_mined_rule(rule: Column) -> Column:
    return F.startswith(rule, F.lit("alert"))


def with_mined_sid(rule: Column, sid: Column, mode: str = "last") -> Column:
    """Number a mined rule.

    ``last`` rewrites the closing parenthesis only and drops an older revision;
    ``reference`` rewrites every closing parenthesis, even inside content.
    """
    ending = F.concat(F.lit("; sid:"), sid.cast("string"), F.lit("; rev:1;)"))
    bare = F.regexp_replace(rule, SID_OPTION, "")
    if mode == "reference":
        return F.replace(bare, F.lit(")"), ending)
    bare = F.regexp_replace(bare, REV_OPTION, "")
    # Greedy up to the last parenthesis; what follows it stays.
    return F.replace(F.regexp_replace(bare, r"(?s)\A(.*?)[;\s]*\)([^)]*)\z", f"$1{HELD}$2"), F.lit(HELD), ending)


def sanitise_suggestion(body: Column, mode: str = "last") -> Column:
    """One-line rule of a stored suggestion; null when it holds no rule action.

    ``last`` cuts after the last ``;)``, ``reference`` after the last ``);``.
    """
    flat = _squeeze(_one_line(F.trim(body, F.lit(" \t\n\r\x0b\x0c"))))
    rule = F.regexp_extract(flat, r"(?d)\b(?:" + "|".join(RULE_ACTIONS) + r")\b.*", 0)
    end = r"\);" if mode == "reference" else r";\)"
    return F.nullif(F.regexp_replace(rule, r"(?d)\A(.*" + end + r").*\z", "$1"), F.lit(""))
