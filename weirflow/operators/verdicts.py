"""What becomes of a packet, where work is placed, and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from . import state


def verdict(result: Column) -> Column:
    """A packet whose result is 0 is dropped, any other is forwarded."""
    return F.when(result != 0, "forward").otherwise("drop")


def routed(df: DataFrame, result: Column) -> DataFrame:
    return df.withColumn("verdict", verdict(result))


def forward_to(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes the packets that are forwarded."""
    df.where("verdict = 'forward'").write.format(fmt).mode("append").save(path)


def placement(kind: str, workers: int, fixed: int = 0) -> Column:
    """The worker that a key is placed at: local (-1: wherever the packet is), static, hashing, balanced."""
    if kind == "local":
        return F.lit(-1)
    if kind == "static":
        return F.lit(fixed)
    if kind == "hashing":
        return F.pmod(F.col("src_ip") + F.col("dst_ip") + F.col("src_port") + F.col("dst_port"), F.lit(workers)).cast("int")
    if kind == "balanced":
        return F.pmod(keys.locality(), F.lit(workers)).cast("int")
    raise ValueError(f"no placement {kind}")


def placed(df: DataFrame, kind: str, workers: int) -> DataFrame:
    """df dealt so that packets of a worker are together."""
    return df if kind == "local" else df.withColumn("worker", placement(kind, workers)).repartition(workers, "worker")


#: Of the ranks of a percentile, the error is at most one in so many; up to so many values it is exact.
ACCURACY = 100_000


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """n, average, p50 and p99 of a column, from sketches that leave each task."""
    p = F.percentile_approx(value, [0.5, 0.99], ACCURACY)
    return df.agg(F.count(value).alias("n"), F.round(F.avg(value), 3).alias("average"), F.round(p[0], 3).alias("p50"), F.round(p[1], 3).alias("p99"))


def jitter(df: DataFrame, flow: list[str]) -> DataFrame:
    """Median and 99th percentile of the seconds between packets of a flow, over all flows."""
    at = F.col("ts").cast("timestamp").cast("double")
    gaps = state.previous(df.select("pkt_id", "ts", *flow), flow, at, "before")
    return percentiles(gaps.where("before is not null").select((at - F.col("before")).alias("gap")), "gap").drop("average")


def round_trips(df: DataFrame) -> DataFrame:
    """Average, median and 99th percentile of the seconds from a packet to the next of its connection, where that comes from the other side."""
    at = F.col("ts").cast("timestamp").cast("double")
    keyed = df.select("pkt_id", "ts", *keys.sym_flow(), keys.forward().alias("ahead"))
    pairs = state.previous(keyed, list(keys.SYM), F.struct("ahead", at.alias("at")), "before")
    return percentiles(pairs.where("before.ahead != ahead").select((at - F.col("before.at")).alias("rtt")), "rtt")


def throughput(df: DataFrame, seconds: int = 1) -> DataFrame:
    """Packets and bits by window of time."""
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds
    return df.groupBy(at.alias("started")).agg(F.count(F.lit(1)).alias("packets"), (F.sum("pkt_len") * 8).cast("long").alias("bits"))


def weighted_median(histogram: DataFrame, value: str, weight: str) -> DataFrame:
    """The largest value and the median of a histogram."""
    return histogram.agg(F.max(value).alias("most"), F.percentile(value, F.lit(0.5), F.col(weight)).alias("median"))


def sessions(df: DataFrame, by: list[str], idle: str = "300 seconds") -> DataFrame:
    """Runs of packets of a key without a pause of idle."""
    return df.groupBy(*by, F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.min("ts").alias("started")).drop("w")
