"""Counters by address, subnet, port and flow. All are sums, so partial sums leave each task and a frequent key costs its task one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys


def counted(df: DataFrame, *by: Column | str) -> DataFrame:
    """packets and bytes by key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.sum("pkt_len").cast("long").alias("bytes"))


def by_ip(df: DataFrame, ip: str) -> DataFrame:
    return counted(df, F.col(ip).alias("ip"))


def by_subnet(df: DataFrame, ip: str, prefix: int, charge: int = 64) -> DataFrame:
    """packets, and charged: a fixed charge for each."""
    return df.groupBy(keys.subnet(ip, prefix).alias("subnet")).agg(F.count(F.lit(1)).alias("packets"), (F.count(F.lit(1)) * charge).alias("charged"))


def by_port(df: DataFrame, port: str) -> DataFrame:
    return counted(df, F.col(port).alias("port"))


def by_udp_flow(df: DataFrame) -> DataFrame:
    return counted(df.where("proto = 17"), *keys.FLOW)


def report(counters: DataFrame) -> DataFrame:
    """How many keys there are and what they counted."""
    return counters.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("packets"), F.lit(0)).cast("long").alias("total"))


def padded(df: DataFrame, ip: str, size: int) -> DataFrame:
    """Packets by address with a state that fills size bytes (8 of them the counter)."""
    out = df.groupBy(F.col(ip).alias("ip")).agg(F.count(F.lit(1)).alias("packets"))
    return out.withColumn("state_bytes", F.lit(8) + F.octet_length(F.repeat(F.lit("0"), size - 8)))


def protocol_stats(frames: DataFrame, os_rows: DataFrame, service_rows: DataFrame) -> DataFrame:
    """One row of the detector's 23 counters. frames: dispatched ones. os_rows: ip and sig_id of systems found from TCP packets; service_rows: ip, client, service, port and proto of packets to known services.

    Nothing is detected from UDP, ICMP or DHCP packets' forms, and IPv6 isn't opened, so those counters are 0.
    """

    def n(test: str) -> Column:
        return F.count(F.when(F.expr(test), 1))

    def different(test: str, *of: str) -> Column:
        return F.count_distinct(F.when(F.expr(test), F.struct(*of)))

    tcp, udp = "proto = 6", "proto = 17"
    packets = frames.agg(
        F.count(F.lit(1)).alias("got_packets"), F.count(F.lit(1)).alias("eth_recv"), n("link = 'arp'").alias("arp_recv"), n("link = 'other'").alias("otherl_recv"), n("vlan is not null").alias("vlan_recv"),
        n("link = 'ip4'").alias("ip4_recv"), n("link = 'ip6'").alias("ip6_recv"), n("transport = 'ip4ip'").alias("ip4ip_recv"), F.lit(0).cast("long").alias("ip6ip_recv"), n("transport = 'gre'").alias("gre_recv"),
        n("transport = 'tcp'").alias("tcp_recv"), n("transport = 'udp'").alias("udp_recv"), n("transport = 'icmp'").alias("icmp_recv"), n("transport = 'other'").alias("othert_recv"), different("link = 'ip4'", "src_ip").alias("assets"),
    )
    systems = os_rows.agg(F.count_distinct("ip", "sig_id").alias("tcp_os_assets"), *(F.lit(0).cast("long").alias(f"{k}_os_assets") for k in ("udp", "icmp", "dhcp")))
    services = service_rows.agg(*(x for name, test in (("tcp", tcp), ("udp", udp)) for x in (different(test, "ip", "service", "port").alias(f"{name}_services"), different(test, "client").alias(f"{name}_clients"))))
    # three rows side by side, by a key of one value
    one = F.lit(1).alias("one")
    return packets.select("*", one).join(systems.select("*", one), "one").join(services.select("*", one), "one").drop("one")
