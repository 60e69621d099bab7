"""Asset inventories by address. A list of an asset is a table of its own; lists are put together last and sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assets(df: DataFrame) -> DataFrame:
    """ip, first_seen, last_seen (whole seconds), attempts (packets after the first), and the port and VLAN (0: none) of the last packet, of each sender. Packets without a column vlan have none."""
    vlan = F.coalesce(F.col("vlan"), F.lit(0)).cast("int") if "vlan" in df.columns else F.lit(0)
    last = F.struct("ts", "pkt_id")
    return df.groupBy(F.col("src_ip").alias("ip")).agg(
        F.date_trunc("second", F.min("ts")).alias("first_seen"), F.date_trunc("second", F.max("ts")).alias("last_seen"), (F.count(F.lit(1)) - 1).alias("attempts"), F.max_by("src_port", last).alias("last_port"), F.max_by(vlan, last).alias("vlan")
    )


def listed(hits: DataFrame, *by: str) -> DataFrame:
    """One row for each asset and detection: attempts (hits after the first), first and last time. hits: ip, ts and the columns of by."""
    return hits.groupBy("ip", *by).agg((F.count(F.lit(1)) - 1).alias("attempts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def with_lists(table: DataFrame, os_rows: DataFrame, service_rows: DataFrame) -> DataFrame:
    """Assets with their lists of systems and services: as many entries as there are signatures and known ports."""

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        own = [c for c in rows.columns if c != "ip"]
        return rows.groupBy("ip").agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name))

    return table.join(gathered(os_rows, "oses"), "ip", "left").join(gathered(service_rows, "services"), "ip", "left")


def context(df: DataFrame, ip: str, systems: int = 4, services: int = 5) -> DataFrame:
    """For each address, how many systems and services were seen, and the count and the last time of each. df: os_id and service_id of each packet, null where nothing was detected."""

    def by(column: str, name: str, n: int) -> list:
        out = []
        for k in range(n):
            hit = F.when(F.col(column) == k, F.col("ts"))
            out += [F.count(hit).alias(f"{name}_{k}"), F.max(hit).alias(f"{name}_{k}_last")]
        return out

    return df.groupBy(F.col(ip).alias("ip")).agg(F.count_distinct("os_id").alias("os_count"), F.count_distinct("service_id").alias("service_count"), *by("os_id", "os", systems), *by("service_id", "service", services))


def of_connections(connections: DataFrame, table: DataFrame) -> DataFrame:
    """Connections with the assets of their client and server: who sent the first packet and whom it was for, turned round where a SYN-ACK says so. Sides that sent nothing have no asset."""
    turned = F.col("answered")
    from_a = F.col("s_ip") == F.col("a_ip")
    other = F.when(from_a, F.col("b_ip")).otherwise(F.col("a_ip"))
    sided = connections.withColumns({"client": F.when(turned, other).otherwise(F.col("s_ip")), "server": F.when(turned, F.col("s_ip")).otherwise(other)})
    for side in ("client", "server"):
        own = table.select(F.col("ip").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("first_seen", "last_seen", "attempts")))
        sided = sided.join(own, side, "left")
    return sided
