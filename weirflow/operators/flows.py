"""Flow tables: one-way TCP flows and connections of both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags, keys
from .state import ORDER, with_generations


def first(column: str):
    return F.min_by(column, F.struct(*ORDER))


def tcp_flows(df: DataFrame) -> DataFrame:
    """TCP flows that begin with SYN or SYN-ACK (from the server), one row for each directed key: which end serves, packets, bytes to and from the server, first and last time. Flows that begin otherwise are there with set false and nothing counted."""
    tcp = df.where("proto = 6")
    per = tcp.groupBy(*keys.FLOW).agg(F.count(F.lit(1)).alias("n"), F.sum("pkt_len").cast("long").alias("bytes"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), first("tcp_flags").alias("opening"))
    syn, ack = (F.col("opening").bitwiseAND(F.lit(m)) != 0 for m in (flags.SYN, flags.ACK))
    from_server = syn & ack
    return per.select(
        *keys.FLOW,
        syn.alias("set"),
        F.when(from_server, F.col("src_ip")).when(syn, F.col("dst_ip")).alias("svr_ip"),
        F.when(from_server, F.col("src_port")).when(syn, F.col("dst_port")).alias("svr_port"),
        F.when(syn, F.col("n")).otherwise(0).alias("pkt_cnt"),
        F.when(from_server, F.col("bytes")).otherwise(0).alias("s2c_bytes"),
        F.when(syn & ~ack, F.col("bytes")).otherwise(0).alias("c2s_bytes"),
        "start_time",
        "end_time",
    )


def connections(df: DataFrame) -> DataFrame:
    """One row for each connection (key of either direction, and generation). The source is the sender of its first packet.

    Packets, bytes and joined flags by direction, first and last time; and answered: whether the
    last SYN-ACK, if there was one, came from the destination. The protocol isn't part of the key.
    """
    keyed = df.select("pkt_id", "ts", *keys.FLOW, "proto", "tcp_flags", "pkt_len", *keys.sym_flow())
    versions = with_generations(keyed, list(keys.SYM)).withColumn("ahead", keys.forward())
    flag = F.when(F.col("proto") == 6, F.col("tcp_flags")).otherwise(0)
    synack = (F.col("proto") == 6) & flags.all_of(flags.SYN | flags.ACK)

    def by_side(name: str, make, none) -> list:
        return [F.coalesce(make(side), F.lit(none)).alias(f"{name}_{k}") for k, side in enumerate((F.col("ahead"), ~F.col("ahead")))]

    # both sides are plain sums; which of them is the source is known when all are there
    both = versions.groupBy(*keys.SYM, "version").agg(
        first("ahead").alias("from_a"), F.max_by("ahead", F.when(synack, F.struct(*ORDER))).alias("answer_a"),
        *by_side("pkts", lambda t: F.count(F.when(t, 1)), 0), *by_side("bytes", lambda t: F.sum(F.when(t, F.col("pkt_len"))), 0), *by_side("flags", lambda t: F.bit_or(F.when(t, flag)), 0),
        F.min("ts").alias("start_time"), F.max("ts").alias("last_pkt_time"),
    )

    def side(name: str, source: bool):
        a, b = (F.col(f"{name}_{k}") for k in ((0, 1) if source else (1, 0)))
        return F.when(F.col("from_a"), a).otherwise(b)

    return both.select(
        *keys.SYM, "version",
        F.when(F.col("from_a"), F.col("a_ip")).otherwise(F.col("b_ip")).alias("s_ip"), F.when(F.col("from_a"), F.col("a_port")).otherwise(F.col("b_port")).alias("s_port"),
        *(side(name, source).cast("int" if name == "flags" else "long").alias(f"{'s' if source else 'd'}_{name}") for name in ("pkts", "bytes", "flags") for source in (True, False)),
        "start_time", "last_pkt_time", F.coalesce(F.col("answer_a") != F.col("from_a"), F.lit(False)).alias("answered"),
    )


def turned(df: DataFrame) -> DataFrame:
    """connections(), with the sides of those that were answered turned round. Each SYN-ACK from what is then the destination turns a connection, so in the end the source is who sent the last one."""
    out = connections(df)
    r = F.col("answered")
    sides = [F.when(r, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("s_pkts", "d_pkts"), ("d_pkts", "s_pkts"), ("s_bytes", "d_bytes"), ("d_bytes", "s_bytes"), ("s_flags", "d_flags"), ("d_flags", "s_flags"))]
    return out.select(*keys.SYM, "version", r.alias("reversed"), *sides)


def roles(df: DataFrame) -> DataFrame:
    """pkt_id, role: client or server for packets after the first of their connection, by whether they come from its source; the first has none."""
    keyed = with_generations(df.select("pkt_id", "ts", *keys.FLOW, "proto", "tcp_flags", *keys.sym_flow()), list(keys.SYM)).withColumn("ahead", keys.forward())
    key = [*keys.SYM, "version"]
    opened = keyed.where("created").select(*key, F.col("ahead").alias("from_a"))  # one row for each connection
    return keyed.join(opened, key, "left").select("pkt_id", F.when(F.col("created"), None).when(F.col("ahead") == F.col("from_a"), "client").otherwise("server").alias("role"))
