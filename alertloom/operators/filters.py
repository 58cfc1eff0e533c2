"""Row filters on packets, alerts and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.network import decode_payload, in_cidr, is_printable

# Fixed values.
LOCAL_SUBNET = "192.168.1.0/24"
ALLOWED_SOURCE = "192.168.1.44"
IGNORED_PORTS = (22, 514)
TRANSPORTS = ("tcp", "udp")
MIN_PAYLOAD = 5
FACILITY = "local5"


def from_outside(src_ip: Column, subnet: str = LOCAL_SUBNET, allowed: str = ALLOWED_SOURCE) -> Column:
    return src_ip.isNotNull() & (~in_cidr(src_ip, subnet) | (src_ip == allowed))


def is_transport(protocol: Column) -> Column:
    return protocol.isin(*TRANSPORTS)


def not_management(dst_port: Column) -> Column:
    return ~dst_port.isin(*IGNORED_PORTS)


def long_enough(text: Column) -> Column:
    return F.length(text) >= MIN_PAYLOAD


def inspectable(packets: DataFrame) -> DataFrame:
    """Packets worth scoring, with the decoded payload as ``message``.

    Protocol and port tests reach the scan; the payload is decoded once and only
    for rows that pass the cheap tests.
    """
    cheap = packets.where(
        is_transport(F.col("protocol")) & not_management(F.col("dst_port")) & from_outside(F.col("src_ip"))
    )
    # A payload that fails the text tests becomes no element at all.
    text = F.filter(
        F.array(decode_payload(F.col("payload"))), lambda t: t.isNotNull() & long_enough(t) & is_printable(t)
    )
    others = [c for c in packets.columns if c != "payload"]
    return cheap.select(*others, F.explode(text).alias("message"))


def malicious(df: DataFrame) -> DataFrame:
    return df.where("label = 1")


def benign(df: DataFrame) -> DataFrame:
    return df.where("label = 0")


def informative(df: DataFrame, message: str = "message") -> DataFrame:
    """Without messages that name no attack; the test is case-sensitive."""
    text = F.coalesce(F.col(message), F.lit(""))
    return df.where(~(F.contains(text, F.lit("Generic")) | F.contains(text, F.lit("Unknown"))))


def of_facility(df: DataFrame, facility: str = FACILITY) -> DataFrame:
    return df.where(F.col("facility") == facility)
