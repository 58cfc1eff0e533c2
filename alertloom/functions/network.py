"""Address and payload predicates, as native expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

# Fixed value: space to tilde, tab, line feed, carriage return, vertical tab, form feed.
PRINTABLE = r"\A[\x20-\x7e\t\n\r\x0b\x0c]+\z"


OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"\A(?:{OCTET}\.){{3}}{OCTET}\z"
NETWORK = rf"\A(?:{OCTET}\.){{3}}{OCTET}(?:/(?:3[0-2]|[12]?[0-9]))?\z"


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number; null for anything else."""
    zero = F.lit(0).cast("long")
    number = F.aggregate(F.split(ip, r"\."), zero, lambda so_far, octet: so_far * 256 + octet.cast("long"))
    return F.when(ip.rlike(IPV4), number)


def in_cidr(ip: Column, net: str) -> Column:
    """True when the IPv4 text lies in the network.

    Whole octets of the prefix are compared as text first, which settles most
    addresses without reading them as numbers.
    """
    network = ipaddress.ip_network(net)
    low, high = int(network.network_address), int(network.broadcast_address)
    whole = str(network.network_address).split(".")[: network.prefixlen // 8]
    inside = ip_number(ip).between(low, high)
    if whole:
        inside = F.startswith(ip, F.lit(".".join(whole) + ("." if len(whole) < 4 else ""))) & inside
    return F.coalesce(inside, F.lit(False))


def cidr_bounds(net: Column) -> tuple[Column, Column]:
    """First and last address of a network given as a column (``a.b.c.d`` or ``a.b.c.d/n``)."""
    base = ip_number(F.substring_index(net, "/", 1))
    bits = F.coalesce(F.get(F.split(net, "/"), F.lit(1)).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    low = base - base % size
    return low, low + size - 1


def decode_payload(payload: Column) -> Column:
    """Strict UTF-8 text of the bytes; null when they are not UTF-8."""
    return F.try_validate_utf8(payload.cast("string"))


def is_printable(text: Column) -> Column:
    return text.rlike(PRINTABLE)
