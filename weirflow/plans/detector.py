"""Queries of the asset detector: frames of all sorts, its counters, assets with their lists, and the files it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets, counters, dispatch, flows, match, reassembly
from ..sources import rules
from ..sources.packets import both_ways, decode_frames, mixed_frames, packets
from ..sources.shared import written_lines
from .catalog import SYSTEM_LINES
from .registry import query

#: Ports whose services an asset's context counts, by their number there.
CONTEXT_PORTS = (80, 443, 22, 53, 8080)

#: Lines of small files that the readers are shown with.
SIGNATURE_LINES = ["# systems", *SYSTEM_LINES, "", "S20:64:1:*:M*,N,N,T0,?55:ZA:-*Last:old"]
SERVICE_LINES = ["# services", "www,v/SampleHTTPD/$1//,Server: Sample/([0-9.]+)", "ssh,v/SampleSSH/$2/$1/,SSH-([.0-9]+)-Sample_(\\S+)", "broken", "mail,v/Mailer//misc/,^220 .*, ready"]
VENDOR_LINES = ["02:FE:00 SampleVendor # test", "0A-00-00-01/28 Second Vendor", "#x", "AABBCC\tThird"]
RULE_LINES = ['alert tcp any any -> any 80 (msg:"a"; content:"evil"; pcre:"/ev[i1]l/i";)', "# none", 'alert udp any any (content:"x|41|y"; content:"second";)', 'alert (pcre:"plain[0-9]";)', "alert tcp (nothing)"]
CONFIG_LINES = ["# detector", "os_syn_fingerprint=1", "interface = eth0 # the first", "os_syn_fingerprint=0", "empty=", "no value"]


def heads(p: DataFrame) -> DataFrame:
    """Header fields of TCP packets, made from their numbers."""
    a, n = F.col("pkt_id") % 3, F.col("pkt_id")
    options = F.when(a == 0, F.array(*map(F.lit, (2, 4, 8, 1, 3)))).when(a == 1, F.array(*map(F.lit, (2, 1, 3, 1, 1, 4)))).otherwise(F.array(F.lit(2)))
    return p.where("proto = 6").select(
        "pkt_id", F.when(a == 0, 60).when(a == 1, 52).otherwise(44).alias("size"), F.size(options).alias("optcnt"), options.alias("opts"), F.lit(1460).alias("mss"), F.when(a == 0, 7).when(a == 1, 8).otherwise(0).alias("wscale"),
        F.when(n % 2 == 0, 5840).otherwise(8192).alias("wsize"), (n % 70).cast("int").alias("ttl"), F.when(n % 5 == 0, 0).otherwise(1).alias("df"), F.lit(0).alias("quirks"), F.when(a == 0, 5).otherwise(0).alias("tstamp"),
    )


def systems(spark: SparkSession, p: DataFrame) -> DataFrame:
    """pkt_id, sig_id of packets that a signature fits."""
    lines = spark.createDataFrame([(k, s) for k, s in enumerate(SYSTEM_LINES)], "line int, value string")
    return match.systems(heads(p), rules.parsed_systems(lines)).where("sig_id is not null")


@query
def os_fingerprint(spark, d):
    return systems(spark, packets(spark, d))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.dispatched(decode_frames(mixed_frames(packets(spark, d))))


@query
def frame_dispatch(spark, d):
    """VLAN tags, what is inside, and how much of it was captured and is payload."""
    return frames(spark, d).select("pkt_id", "vlan", "eth_type", "link", "transport", "captured", "payload_len")


@query
def segments_with_payload(spark, d):
    return reassembly.with_payload(frames(spark, d)).select("pkt_id", "payload_len")


def os_hits(spark: SparkSession, p: DataFrame) -> DataFrame:
    return systems(spark, p).join(p.select("pkt_id", "ts", F.col("src_ip").alias("ip")), "pkt_id")


def service_hits(spark: SparkSession, p: DataFrame) -> DataFrame:
    return match.known_services(p, rules.known_ports(spark)).select(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("client"), "ts", "service", F.col("dst_port").alias("port"), "proto")


@query
def proto_stats(spark, d):
    """The 23 counters of the detector over frames of all sorts."""
    p = packets(spark, d)
    return counters.protocol_stats(frames(spark, d), os_hits(spark, p), service_hits(spark, p).where("service is not null"))


@query
def asset_table(spark, d):
    """Assets of all IPv4 frames, with the VLAN that each was last in."""
    return assets.assets(frames(spark, d).where("link = 'ip4'")).select("ip", "first_seen", "last_seen", "attempts", "vlan")


@query
def asset_os_list(spark, d):
    return assets.listed(os_hits(spark, packets(spark, d)), "sig_id")


@query
def asset_service_list(spark, d):
    return assets.listed(service_hits(spark, packets(spark, d)), "service", "port")


def said(rows: Column, *names: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *(r[n].cast("string") for n in names))), ",")


@query
def asset_inventory(spark, d):
    """Assets of both directions with their lists of systems and known services."""
    p = both_ways(packets(spark, d))
    os_rows, service_rows = (assets.listed(rows, *by).select("ip", *by, "attempts") for rows, by in ((os_hits(spark, p), ["sig_id"]), (service_hits(spark, p).where("service is not null"), ["service", "port"])))
    out = assets.with_lists(assets.assets(p), os_rows, service_rows)
    return out.select("ip", "attempts", said(F.col("oses"), "sig_id", "attempts").alias("oses"), said(F.col("services"), "service", "port", "attempts").alias("services"))


def detected(spark: SparkSession, d: str) -> DataFrame:
    """Packets with os_id, the signature they fit, and service_id, by their destination port."""
    p = packets(spark, d)
    port = F.array_position(F.array(*map(F.lit, CONTEXT_PORTS)), F.col("dst_port"))
    return p.join(systems(spark, p).withColumnRenamed("sig_id", "os_id"), "pkt_id", "left").withColumn("service_id", F.when(port > 0, port - 1))


@query
def asset_context_src(spark, d):
    return assets.context(detected(spark, d), "src_ip")


@query
def asset_context_dst(spark, d):
    return assets.context(detected(spark, d), "dst_ip")


@query
def connection_assets(spark, d):
    """Connections with the assets of client and server."""
    p = both_ways(packets(spark, d))
    out = assets.of_connections(flows.connections(p), assets.assets(p))
    return out.select("a_ip", "b_ip", "a_port", "b_port", "version", "client", "server", "client_first_seen", "client_attempts", "server_first_seen", "server_attempts")


@query
def read_os_signatures(spark, d):
    out = rules.os_signatures(spark, written_lines(spark, "signatures", SIGNATURE_LINES))
    return out.withColumn("opts", F.array_join(F.transform("opts", lambda o: o.cast("string")), ","))


@query
def read_service_signatures(spark, d):
    return rules.service_signatures(spark, written_lines(spark, "services", SERVICE_LINES))


@query
def read_vendors(spark, d):
    return rules.mac_vendors(spark, written_lines(spark, "vendors", VENDOR_LINES))


@query
def read_ids_rules(spark, d):
    return rules.ids_rules(spark, written_lines(spark, "rules", RULE_LINES))


@query
def read_config(spark, d):
    return rules.config(spark, written_lines(spark, "config", CONFIG_LINES))
