"""What a frame is, by its ether type and then its IP protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ether types and IP protocols.
ETHER = {"ip4": 0x0800, "arp": 0x0806, "ip6": 0x86DD}
PROTOCOLS = {"icmp": (1,), "ip4ip": (4, 41), "tcp": (6,), "udp": (17,), "gre": (47,)}


def link(eth_type: str = "eth_type") -> Column:
    """ip4, arp, ip6 or other."""
    out = F.lit("other")
    for name, number in ETHER.items():
        out = F.when(F.col(eth_type) == number, name).otherwise(out)
    return out


def transport(eth_type: str = "eth_type", proto: str = "proto") -> Column:
    """tcp, udp, icmp, ip4ip (IP in IPv4), gre or other of an IPv4 frame; null of other frames."""
    out = F.lit("other")
    for name, numbers in PROTOCOLS.items():
        out = F.when(F.col(proto).isin(*numbers), name).otherwise(out)
    return F.when(F.col(eth_type) == ETHER["ip4"], out)


def dispatched(frames: DataFrame) -> DataFrame:
    """Decoded frames with link and transport."""
    return frames.withColumns({"link": link(), "transport": transport()})
