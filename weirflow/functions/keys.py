"""Key and address expressions. Addresses are unsigned 32-bit numbers in bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOW = ("src_ip", "dst_ip", "src_port", "dst_port")
SYM = ("a_ip", "b_ip", "a_port", "b_port")


def forward() -> Column:
    """Whether a packet goes from the smaller end (address, then port) to the larger."""
    return (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))


def sym_flow() -> list[Column]:
    """The key of a flow in either direction: a_ip, b_ip, a_port, b_port, a the smaller end."""
    f = forward()
    pairs = (("a_ip", "src_ip", "dst_ip"), ("b_ip", "dst_ip", "src_ip"), ("a_port", "src_port", "dst_port"), ("b_port", "dst_port", "src_port"))
    return [F.when(f, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in pairs]


def subnet(ip: str, prefix: int) -> Column:
    """The first prefix bits of an address, as a number."""
    if not 1 <= prefix <= 32:
        raise ValueError("a prefix has 1 to 32 bits")
    return F.shiftright(F.col(ip), 32 - prefix)


def dotted(ip: str) -> Column:
    return F.concat_ws(".", *(F.shiftright(F.col(ip), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def locality(src_bytes: int = 4, dst_bytes: int = 4, sp_bytes: int = 0, dp_bytes: int = 0) -> Column:
    """Sum of leading bytes of both addresses and ports: equal for packets that are to meet in one place."""
    out = F.lit(0).cast("long")
    for name, width, n in (("src_ip", 4, src_bytes), ("dst_ip", 4, dst_bytes), ("src_port", 2, sp_bytes), ("dst_port", 2, dp_bytes)):
        for k in range(n):
            out = out + F.shiftright(F.col(name).cast("long"), 8 * (width - 1 - k)).bitwiseAND(F.lit(255))
    return out


def locality_rule(rule: str) -> Column:
    """locality() from a rule sip:sp->dip:dp of byte counts."""
    left, right = rule.split("->")
    (sip, sp), (dip, dp) = (map(int, side.split(":")) for side in (left, right))
    return locality(sip, dip, sp, dp)


def name_key(name: Column) -> Column:
    """The key of a named singleton: SHA-1 of the name's first seven bytes."""
    return F.sha1(F.substring(name, 1, 7))


def checksum(words: Column) -> Column:
    """The IPv4 header checksum of a list of 16-bit numbers, the checksum's own being 0."""
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w)
    once = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(total, 16)
    return F.lit(0xFFFF) - (once.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(once, 16))


def in_net(ip: str, net: str) -> Column:
    """Whether an address is in a.b.c.d/bits: a range, so scans can skip what lies outside."""
    base, bits = net.split("/")
    number = 0
    for part in base.split("."):
        number = number * 256 + int(part)
    size = 1 << (32 - int(bits))
    return F.col(ip).between(number // size * size, number // size * size + size - 1)


def all_set(value: Column, mask: int) -> Column:
    """Whether all bits of a mask are set: which checks a configuration has switched on."""
    return value.bitwiseAND(F.lit(mask)) == mask
