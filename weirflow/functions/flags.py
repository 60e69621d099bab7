"""TCP flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128


def has(mask: int, column: str = "tcp_flags") -> Column:
    """Whether any of the flags is set."""
    return F.col(column).bitwiseAND(F.lit(mask)) != 0


def all_of(mask: int, column: str = "tcp_flags") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask)) == mask


def closes() -> Column:
    """Whether a packet ends its connection; only TCP has flags."""
    return (F.col("proto") == 6) & has(FIN | RST)


def kind() -> Column:
    """syn, synack, fin, rst, ack (alone or with PSH) or other."""
    return F.when(F.col("proto") != 6, "other").when(all_of(SYN | ACK), "synack").when(has(SYN), "syn").when(has(FIN), "fin").when(has(RST), "rst").when(has(ACK), "ack").otherwise("other")


def quirks(kind_flag: int) -> Column:
    """Bits of oddities of a TCP header seq, ack, urg and flags, looked at as a packet of that kind."""
    allowed = SYN | ACK | RST | ECE | CWR | (PSH if kind_flag == ACK else 0)
    tests = [
        (1024, F.lit(kind_flag == RST) & has(ACK)),
        (8192, F.lit(kind_flag == FIN) & has(ACK)),
        (2048, F.col("seq") == F.col("ack")),
        (4096, F.col("seq") == 0),
        (128, has(255 & ~allowed)),
        (32, F.col("ack") != 0),
        (8, F.col("urg") != 0),
    ]
    out = F.lit(0)
    for bit, test in tests:
        out = out.bitwiseOR(F.when(test, bit).otherwise(0))
    return out
