"""Queries over the packets as a stream, driven through all that there is; what they write lies in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import SYM
from ..sources.packets import both_ways, packet_stream
from ..sources.shared import new_folder
from ..streaming import processors
from .registry import query


@query
def stream_src_ip_counter(spark, d):
    path = new_folder(spark, "stream-counter")
    processors.run_changes(processors.count_by(packet_stream(spark, d), F.col("src_ip").alias("ip")), f"{path}/rows", f"{path}/checkpoint")
    return processors.latest(spark, f"{path}/rows", ["ip"])


@query
def stream_flow_generation(spark, d):
    path = new_folder(spark, "stream-generation")
    processors.run_to(processors.generations(packet_stream(spark, d)), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


@query
def stream_connection(spark, d):
    path = new_folder(spark, "stream-connection")
    stream = packet_stream(spark, d)
    both = both_ways(stream)
    processors.run_changes(processors.connections(both), f"{path}/rows", f"{path}/checkpoint")
    out = processors.latest(spark, f"{path}/rows", [*SYM, "version"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "last_pkt_time")})


@query
def stream_stale_counter(spark, d):
    path = new_folder(spark, "stream-stale")
    processors.run_to(processors.stale(packet_stream(spark, d).select("pkt_id", "ts", "dst_ip"), "dst_ip", 86_400), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


@query
def stream_progress(spark, d):
    """What a stream has received and how much of it left as rows."""
    path = new_folder(spark, "stream-progress")
    done = processors.run_to(packet_stream(spark, d).where("proto = 6"), f"{path}/rows", f"{path}/checkpoint")
    received = sum(p["numInputRows"] for p in done)
    return spark.read.parquet(f"{path}/rows").agg(F.lit(received).cast("long").alias("received"), F.count(F.lit(1)).alias("processed"), (F.lit(received) - F.count(F.lit(1))).alias("dropped"))
