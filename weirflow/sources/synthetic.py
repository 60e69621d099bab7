"""Synthetic packets: deterministic, each row from its own number, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARETO_ALPHA, PARETO_TAIL = 1.3, 0.99


def uniform(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / float(1 << 52)


def udp_packets(spark: SparkSession, n: int = 4096) -> DataFrame:
    """UDP packets with sources 192.168.0.(i % 255), destinations 10.0.0.(i % 255) and source ports 1234 + i."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("pkt_id"),
        (F.lit(3_232_235_520) + i % 255).alias("src_ip"),
        (F.lit(167_772_160) + i % 255).alias("dst_ip"),
        ((F.lit(1234) + i) % 65536).cast("int").alias("src_port"),
        F.lit(5678).alias("dst_port"),
        F.lit(17).alias("proto"),
        F.lit(60).cast("long").alias("pkt_len"),
    )


def offset(j: Column, n: int, k: int, span: int) -> Column:
    """The address offset of the j-th flow (from 0) of partition k of n: it goes up by n and starts again at k when it reaches span. Span 0: no offset."""
    if span <= 0:
        return F.lit(0).cast("long")
    turns = max(1, -(-(span - k) // n))  # how many offsets there are
    return (F.lit(k) + F.pmod(j + 1, F.lit(turns)) * n).cast("long")


def flows(spark: SparkSession, n_flows: int, pps: float = 1000.0, flow_rate: float = 10.0, duration: float = 10.0, arrival: str = "uniform", durations: str = "uniform", n: int = 1, k: int = 0, ip_span: int = 10, port_span: int = 20_000, seed: int = 1) -> DataFrame:
    """Packets of simulated TCP flows: the first has SYN, the last FIN with ACK, those between ACK.

    Flows begin 1/flow_rate seconds apart (uniform) or at gaps from an exponential distribution;
    they have pps / flow_rate packets, or a number from a Pareto distribution of that mean whose
    last hundredth is cut off. ts is in seconds from the start.
    """
    if flow_rate > pps:
        raise ValueError("more flows than packets")
    j, u = F.col("id"), uniform(F.lit(seed), F.col("id"))
    mean = pps / flow_rate
    if durations == "pareto":
        a = 1 / PARETO_ALPHA
        own_mean = (1 - (1 - PARETO_TAIL) ** (1 - a)) / ((1 - a) * PARETO_TAIL)
        count = 1 + (F.pow(1 / (1 - u * PARETO_TAIL), F.lit(a)) - 1) / (own_mean - 1) * (mean - 1)
    else:
        count = F.lit(mean)
    gap = F.lit(1 / flow_rate) if arrival == "uniform" else -F.log(1 - uniform(F.lit(seed + 1), j)) / flow_rate
    base = spark.range(n_flows).select(j.alias("flow_id"), F.greatest(F.lit(1), F.floor(count)).cast("int").alias("packets"), gap.alias("gap"), offset(j, n, k, ip_span).alias("ip_off"), offset(j, n, k, port_span).alias("port_off"))
    if arrival == "uniform":
        started = base.withColumn("start", F.col("flow_id") / flow_rate)
    else:  # sums within slices of flows, then of slices: no single task has all flows
        from pyspark.sql import Window

        sliced = base.withColumn("slice", F.floor(F.col("flow_id") / 4096))
        sums = sliced.groupBy("slice").agg(F.sum("gap").alias("all"))
        before = sums.select("slice", (F.sum("all").over(Window.orderBy("slice")) - F.col("all")).alias("before"))
        started = sliced.join(before, "slice").withColumn("start", F.col("before") + F.sum("gap").over(Window.partitionBy("slice").orderBy("flow_id")) - F.col("gap"))
    out = started.select("*", F.explode(F.sequence(F.lit(1), F.col("packets"))).alias("nth"))
    flags = F.when(F.col("nth") == 1, 2).otherwise(16) + F.when(F.col("nth") == F.col("packets"), 1).otherwise(0)
    return out.select(
        "flow_id",
        "nth",
        (F.col("start") + (F.col("nth") - 1) * (duration / mean)).alias("ts"),
        (F.lit(167_772_160) + F.col("ip_off")).alias("src_ip"),
        (F.lit(3_232_235_520) + F.col("ip_off")).alias("dst_ip"),
        (F.lit(1024) + F.col("port_off")).cast("int").alias("src_port"),
        (F.lit(80) + F.col("port_off")).cast("int").alias("dst_port"),
        F.lit(6).alias("proto"),
        flags.alias("tcp_flags"),
    )


def random_update(df: DataFrame, column: str, least: int, span: int, n: int = 1, k: int = 0, key: str = "pkt_id", seed: int = 1) -> DataFrame:
    """column set to least + r moved up to the next number that is k modulo n (counted from least)."""
    r = F.floor(uniform(F.lit(seed), F.col(key)) * span).cast("long")
    return df.withColumn(column, F.lit(least) + r + F.lit(n + k) - r % n)
