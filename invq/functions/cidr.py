"""IPv4 block arithmetic on columns.

A block is ``struct<lo bigint, prefix int>``: its first address and its prefix length. Sizes
reach 2^32, so everything is bigint arithmetic; nothing compares addresses as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the three private blocks, in the order they are tried
PRIVATE_BLOCKS = (
    ("10.0.0.0/8", 167772160, 8),
    ("172.16.0.0/12", 2886729728, 12),
    ("192.168.0.0/16", 3232235520, 16),
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NOTATION = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}(?:/0*(?:3[0-2]|[12]?[0-9]))?\z"


def block_size(prefix: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - prefix)


def truncate(lo: Column, prefix: Column) -> Column:
    """First address of the /prefix block that holds ``lo``."""
    host_bits = F.lit(32) - prefix
    return F.call_function("shiftleft", F.call_function("shiftright", lo, host_bits), host_bits)


def block(lo: Column, prefix: Column) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), prefix.cast("int").alias("prefix"))


def block_end(net: Column) -> Column:
    """The address after the block's last one."""
    return net["lo"] + block_size(net["prefix"])


def parse_cidr(text: Column) -> Column:
    """Block of an IPv4 range in prefix notation, or null.

    Strict: host bits, leading zeros, octets over 255, IPv6 and netmask notation are all null.
    A bare address is a /32.
    """
    address = F.substring_index(text, "/", 1)
    octets = [F.substring_index(F.substring_index(address, ".", n), ".", -1) for n in (1, 2, 3, 4)]
    lo = F.lit(0).cast("bigint")
    for octet in octets:
        lo = lo * 256 + octet.try_cast("bigint")
    prefix = F.coalesce(F.get(F.split(text, "/"), F.lit(1)).try_cast("int"), F.lit(32))
    # bound once by the filter, so that the strict test does not spell the address out again
    shaped = F.array(F.when(text.rlike(_NOTATION), block(lo, prefix)))
    return F.get(F.filter(shaped, lambda b: truncate(b["lo"], b["prefix"]) == b["lo"]), F.lit(0))


def format_cidr(net: Column) -> Column:
    lo = net["lo"]
    octets = [
        F.call_function("shiftright", lo, F.lit(shift)).bitwiseAND(F.lit(255).cast("bigint"))
        for shift in (24, 16, 8, 0)
    ]
    return F.concat(
        F.concat_ws(".", *[o.cast("string") for o in octets]),
        F.lit("/"),
        net["prefix"].cast("string"),
    )


def inside(net: Column, outer: Column) -> Column:
    """Whether ``net`` lies wholly in ``outer`` (or equals it)."""
    return (net["prefix"] >= outer["prefix"]) & (truncate(net["lo"], outer["prefix"]) == outer["lo"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] < block_end(b)) & (b["lo"] < block_end(a))


def lit_block(lo: int, prefix: int) -> Column:
    return block(F.lit(lo), F.lit(prefix))


def private_block_of(net: Column) -> Column:
    """Index (0, 1, 2) of the private block that holds ``net``, or null."""
    chosen = F.lit(None).cast("int")
    for index, (_, lo, prefix) in reversed(list(enumerate(PRIVATE_BLOCKS))):
        chosen = F.when(inside(net, lit_block(lo, prefix)), F.lit(index)).otherwise(chosen)
    return chosen
