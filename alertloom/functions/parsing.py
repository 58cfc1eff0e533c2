"""Alert lines to fields, as native expressions.

Each line is matched by ONE regular expression that rewrites it into its eight
fields joined by a separator, so no field costs a second match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIELDS = (
    "timestamp",
    "signature_id",
    "message",
    "protocol",
    "source_ip",
    "source_port",
    "dest_ip",
    "dest_port",
)

# The two alert line formats.
ISO_STAMP = r"(\d{4}-\d{2}-\d{2}T[\d:\.\-\+]+)\s+"
FAST_STAMP = r"(\d{2}/\d{2}-\d{2}:\d{2}:\d{2}\.\d+)\s+"
SYSLOG_TAG = r"\S+\s+snort:\s+"
MARKER = r"\[\*\*\]\s+"
SIGNATURE = r"\[(\d+:\d+:\d+)\]\s+"
MESSAGE = r'"(.*?)"\s+'
METADATA = r"(?:\[Classification:.*?\]\s+)?(?:\[Priority: \d+\]\s+)?"
PROTOCOL = r"\{(.*?)\}\s+"
ENDPOINT = r"(\d{1,3}(?:\.\d{1,3}){3})(?::(\d+))?"

SYSLOG = ISO_STAMP + SYSLOG_TAG + SIGNATURE + MESSAGE + METADATA + PROTOCOL + ENDPOINT + r"\s+->\s+" + ENDPOINT
FAST = (
    FAST_STAMP + MARKER + SIGNATURE + MESSAGE + f"(?:{MARKER})?" + METADATA + PROTOCOL + ENDPOINT + r"\s+->\s+" + ENDPOINT
)

FORMATS = (SYSLOG, FAST)

# A Unicode noncharacter never occurs in interchanged text; a stray one is
# treated like any other undecodable input.
SEPARATOR = "\uFDD0"
REPLACEMENT_CHAR = "\uFFFD"


def _fields_of(line: Column, formats: tuple[str, ...]) -> Column:
    """``array<array<string>>`` with one element for a matching line, else none.

    Formats are tried in order over the whole line, the first that occurs
    anywhere wins. ``(?d)`` makes the dot stop at newline only.
    """
    pattern = "(?d)^(?:" + "|".join(".*?" + f for f in formats) + ").*$"
    n = len(FIELDS)
    rewritten = SEPARATOR.join("".join(f"${g * n + i + 1}" for g in range(len(formats))) for i in range(n))
    clean = F.replace(line, F.lit(SEPARATOR), F.lit(REPLACEMENT_CHAR))
    parts = F.split(F.regexp_replace(clean, pattern, rewritten), SEPARATOR)
    return F.filter(F.array(parts), lambda p: F.size(p) == n)


def _named(parts: Column) -> list[Column]:
    port_or_zero = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("0"))
    return [
        (port_or_zero(parts[i]) if name.endswith("_port") else parts[i]).alias(name) for i, name in enumerate(FIELDS)
    ]


def _alert_struct(line: Column, formats: tuple[str, ...]) -> Column:
    return F.get(F.transform(_fields_of(line, formats), lambda p: F.struct(*_named(p))), F.lit(0))


def parse_syslog_alert(line: Column) -> Column:
    """Struct of the eight fields of a forwarded syslog alert, null when it is none."""
    return _alert_struct(line, (SYSLOG,))


def parse_fast_alert(line: Column) -> Column:
    """Struct of the eight fields of a fast-format alert, null when it is none."""
    return _alert_struct(line, (FAST,))


def matching_fields(line: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """Zero or one field list; meant to be exploded so that the match runs once per line."""
    return _fields_of(line, formats)


def named_fields(parts: Column) -> list[Column]:
    return _named(parts)


def is_alert_line(line: Column) -> Column:
    return line.rlike(f"(?d)(?:{SYSLOG}|{FAST})")


def signature_part(signature_id: Column, index: int) -> Column:
    return F.try_element_at(F.split(signature_id, ":"), F.lit(index + 1)).try_cast("long")


def split_signature(signature_id: Column) -> list[Column]:
    """gid, sid, rev."""
    return [signature_part(signature_id, i).alias(n) for i, n in enumerate(("gid", "sid", "rev"))]


def event_time(timestamp: Column, year: int, zone: str) -> Column:
    """Instant of an alert; the fast format carries neither year nor zone."""
    fast = F.concat(
        F.lit(f"{year}-"), F.substring(timestamp, 1, 2), F.lit("-"), F.substring(timestamp, 4, 2), F.lit("T"),
        F.substring(timestamp, 7, 32), F.lit(zone),
    )
    return F.when(F.substring(timestamp, 3, 1) == "/", fast).otherwise(timestamp).try_cast("timestamp")


def format_alert(
    timestamp: Column, host: Column, signature_id: Column, message: Column, protocol: Column,
    source_ip: Column, source_port: Column, dest_ip: Column, dest_port: Column,
) -> Column:
    """Inverse of :func:`parse_syslog_alert`; null or ``'0'`` ports are left out."""

    def endpoint(ip: Column, port: Column) -> Column:
        text = port.cast("string")
        return F.concat(ip, F.when(text.isNull() | (text == "0"), F.lit("")).otherwise(F.concat(F.lit(":"), text)))

    return F.concat(
        timestamp, F.lit(" "), host, F.lit(" snort: ["), signature_id, F.lit('] "'), message, F.lit('" {'), protocol,
        F.lit("} "), endpoint(source_ip, source_port), F.lit(" -> "), endpoint(dest_ip, dest_port),
    )
