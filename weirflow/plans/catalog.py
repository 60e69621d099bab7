"""The named queries over packets, and the tables of rules that they use. Each takes a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags, keys, tcp_options
from ..functions import strings as S
from ..operators import counters, flows, match, nat, reassembly, state, verdicts
from ..sources import rules, synthetic
from ..sources.packets import as_frames, both_ways, decode_frames, packets
from ..sources.shared import new_folder
from . import maps  # noqa: F401  registers the state tables
from .registry import QUERIES, query

#: Rules for the text tables: id, content, regex.
RULES = [(1, "license", None), (2, None, "[Ll]icensed under the [A-Z]"), (3, "thth", None), (4, None, "[0-9]{3}-[0-9]{4}")]
#: Service signatures: id, service, app, version, misc, regex.
SERVICES = [(0, "mail", "mailer", "$1", "", "@mail([0-9])\\.example"), (1, "text", "prose", "", "en", "^The ")]
#: Vendors: prefix, bits, vendor.
VENDORS = [("0A0000", 24, "First Vendor"), ("0A000001", 32, "Second Vendor"), ("0A", 8, "Family")]
#: Operating-system signatures in file form.
SYSTEM_LINES = ["S4:64:1:60:M*,S,T,N,W7:.:SampleOS:kernel A", "*:128:1:52:M*,N,W8,N,N,S:.:OtherOS:kernel B", "%8192:64:0:44:M1460:.:@Third:any"]


@query
def src_ip_counter(spark, d):
    return counters.by_ip(packets(spark, d), "src_ip")


@query
def dst_ip_counter(spark, d):
    return counters.by_ip(packets(spark, d), "dst_ip")


@query
def counter_report(spark, d):
    return counters.report(counters.by_ip(packets(spark, d), "dst_ip"))


@query
def packets_parse(spark, d):
    return packets(spark, d)


@query
def ip_print(spark, d):
    return packets(spark, d).select("src_ip").distinct().select("src_ip", keys.dotted("src_ip").alias("printed"))


@query
def sym_flow_key(spark, d):
    return both_ways(packets(spark, d)).select("pkt_id", *keys.sym_flow())


@query
def port_key_counter(spark, d):
    return counters.by_port(packets(spark, d), "dst_port")


@query
def locality_hash(spark, d):
    return packets(spark, d).select("pkt_id", keys.locality().alias("h"), keys.locality_rule("4:2->0:1").alias("h_rule"))


@query
def name_keys(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_name", keys.name_key(F.col("n_name")).alias("k"))


@query
def header_checksum(spark, d):
    addresses = [F.shiftright(c, s).bitwiseAND(F.lit(0xFFFF)) for c in ("src_ip", "dst_ip") for s in (16, 0)]
    size, number, rest = F.col("pkt_len").bitwiseAND(F.lit(0xFFFF)), F.pmod("pkt_id", F.lit(65536)), F.lit(64 * 256).cast("long") + F.col("proto")
    words = F.array(F.lit(0x4500).cast("long"), size, number, F.lit(0).cast("long"), rest, *addresses)
    return packets(spark, d).select("pkt_id", keys.checksum(words).alias("checksum"))


def subnet_query(prefix: int) -> None:
    def f(spark, d):
        return counters.by_subnet(packets(spark, d), "src_ip", prefix)

    f.__name__ = f"subnet_counter_{prefix}"
    query(f)


for _prefix in (8, 16, 24, 30, 32):
    subnet_query(_prefix)


@query
def dst_subnet_report(spark, d):
    return counters.report(counters.by_subnet(packets(spark, d), "dst_ip", 30))


@query
def accounting(spark, d):
    return counters.by_subnet(packets(spark, d), "src_ip", 30).select("subnet", "charged", verdicts.verdict(F.lit(-1)).alias("verdict"))


@query
def udp_flow_counter(spark, d):
    return counters.by_udp_flow(packets(spark, d))


@query
def state_size_counter(spark, d):
    sizes = [counters.padded(packets(spark, d), "dst_ip", n) for n in (32, 1024, 32768)]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query
def echo_sink_verdict(spark, d):
    p = packets(spark, d)
    echo, sink = (verdicts.routed(p, F.lit(n)).groupBy("verdict").agg(F.count(F.lit(1)).alias("packets")).withColumn("app", F.lit(app)) for n, app in ((1, "echo"), (0, "sink")))
    return echo.unionByName(sink)


@query
def ids_protocol_verdict(spark, d):
    return verdicts.routed(packets(spark, d), F.when(F.col("proto") == 6, 1).otherwise(0)).groupBy("proto", "verdict").agg(F.count(F.lit(1)).alias("packets"))


@query
def flow_created_flag(spark, d):
    return state.seen_before(packets(spark, d).select("pkt_id", "ts", *keys.FLOW), list(keys.FLOW)).select("pkt_id", (~F.col("known")).alias("created"))


@query
def flow_generation(spark, d):
    return state.with_generations(packets(spark, d), list(keys.FLOW)).select("pkt_id", "version", "created")


@query
def dynamic_flow_counter(spark, d):
    p = packets(spark, d).select("pkt_id", "ts", "dst_ip", "proto", "tcp_flags")
    return state.with_generations(p, ["dst_ip"]).groupBy("dst_ip", "version").agg(F.count(F.lit(1)).alias("packets"))


@query
def remove_at_10(spark, d):
    return state.removed_after(packets(spark, d).where("proto = 17").select("pkt_id", "ts", *keys.FLOW), list(keys.FLOW), 10).select("pkt_id", "version", "count")


@query
def byte_quota(spark, d):
    return state.gated(packets(spark, d).select("pkt_id", "ts", "src_ip", "pkt_len"), ["src_ip"], "pkt_len", 5000).select("pkt_id", "prior", "admitted")


@query
def inc_and_get_running(spark, d):
    return state.running(packets(spark, d).select("pkt_id", "ts", "dst_ip"), ["dst_ip"], F.lit(1), "count").select("pkt_id", "count")


@query
def tcp_flow(spark, d):
    return flows.tcp_flows(packets(spark, d))


@query
def connection(spark, d):
    return flows.connections(both_ways(packets(spark, d))).drop("answered")


@query
def connection_reversed(spark, d):
    return flows.turned(both_ways(packets(spark, d)))


@query
def connection_roles(spark, d):
    return flows.roles(both_ways(packets(spark, d)))


@query
def known_port_join(spark, d):
    return match.known_services(packets(spark, d), rules.known_ports(spark)).select("pkt_id", "service")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id int, content string, regex string")


@query
def ids_string_match(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return match.first_rule(docs, "text", rule_table(spark).where("content is not null")).where("matched is not null").select("doc_id", "matched")


@query
def ids_regex_match(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return match.first_rule(docs, "text", rule_table(spark).where("regex is not null")).where("matched is not null").select("doc_id", "matched")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """TCP packets of payloads (texts by number) that fit a rule."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("pkt_id"), "text")
    hit = match.first_rule(docs, "text", rule_table(spark)).where("matched is not null").select("pkt_id", "matched")
    return packets(spark, d).where("proto = 6").join(hit, "pkt_id")


@query
def attack_count(spark, d):
    return match.attackers(alerts(spark, d)).select("src_ip", "attack_count", "n_flows", F.array_join(F.transform("flows", lambda f: F.concat_ws(":", f["dst_ip"].cast("string"), f["src_port"].cast("string"), f["dst_port"].cast("string"))), ",").alias("flows"))


@query
def ids_pass_fail(spark, d):
    """TCP passes, all else fails."""
    passes = F.col("proto") == 6
    return packets(spark, d).agg(F.count(F.when(passes, 1)).alias("pass_cnt"), F.count(F.when(~passes, 1)).alias("fail_cnt"))


@query
def service_fingerprint(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", match.scanned("text").alias("payload"))
    table = spark.createDataFrame(SERVICES, "sig_id int, service string, app string, version string, misc string, regex string")
    return match.services(docs, "payload", table).where("sig_id is not null").select("doc_id", "sig_id", "service", "title")


@query
def mac_vendor_lpm(spark, d):
    macs = packets(spark, d).select("pkt_id", F.lpad(F.hex("src_ip"), 12, "0").alias("low")).select("pkt_id", F.concat(F.substring("low", 5, 8), F.lit("0000")).alias("mac"))
    vendors = spark.createDataFrame(VENDORS, "prefix string, bits int, vendor string")
    return match.longest_prefix(macs, "mac", vendors).select("pkt_id", "vendor")


def whitelist(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 167_772_160).alias("src_ip"))


@query
def whitelist_semi(spark, d):
    return packets(spark, d).join(whitelist(spark, d), "src_ip", "left_semi").select("pkt_id", "src_ip")


@query
def whitelist_anti(spark, d):
    return packets(spark, d).join(whitelist(spark, d), "src_ip", "left_anti").select("pkt_id", "src_ip")


@query
def whitelist_learned(spark, d):
    return state.seen_before(packets(spark, d).select("pkt_id", "ts", "src_ip"), ["src_ip"]).select("pkt_id", "known")


@query
def nat_table(spark, d):
    return nat.table(packets(spark, d))


@query
def nat_rewrite(spark, d):
    """Packets that leave, and answers to odd ones that come back."""
    p = packets(spark, d)
    table = nat.table(p)
    back = nat.replies(p.where("pkt_id % 2 = 1"), table).withColumn("pkt_id", -F.col("pkt_id") - 1)
    return nat.rewritten(p.select(*back.columns).unionByName(back), table)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """TCP packets as segments of their flow, in an order of their own: seq by a mix of their number."""
    p = packets(spark, d).where("proto = 6").select("pkt_id", "ts", "src_ip", ((F.col("pkt_id") * 7919) % 64 + F.col("pkt_id")).alias("o"))
    mixed = state.summed(p, ["src_ip"], ["o", "pkt_id"], F.floor(F.col("o") / 65536), F.lit(1), "seq")
    return state.running(mixed, ["src_ip"], F.lit(1), "arrival").select("pkt_id", "src_ip", "seq", "arrival")


@query
def reasm_release(spark, d):
    return reassembly.released(segments(spark, d), ["src_ip"])


@query
def reasm_buffer_occupancy(spark, d):
    return reassembly.occupancy(segments(spark, d), ["src_ip"])


def placement_query(kind: str) -> None:
    def f(spark, d):
        return packets(spark, d).groupBy(verdicts.placement(kind, 16, 3).alias("worker")).agg(F.count(F.lit(1)).alias("packets"))

    f.__name__ = f"placement_{kind}"
    query(f)


for _kind in ("local", "static", "hashing", "balanced"):
    placement_query(_kind)


@query
def limit_packets(spark, d):
    return packets(spark, d).orderBy("ts", "pkt_id").limit(96).select("pkt_id", "ts")


@query
def top_talkers(spark, d):
    return counters.by_ip(packets(spark, d), "src_ip").orderBy(F.desc("bytes"), "ip").limit(10)


@query
def synthetic_udp(spark, d):
    return synthetic.udp_packets(spark)


@query
def flow_generator(spark, d):
    return synthetic.flows(spark, 50, pps=50, flow_rate=10, n=3, k=1, ip_span=10, port_span=0).select("flow_id", "nth", F.round("ts", 3).alias("ts"), "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags")


@query
def random_update(spark, d):
    """The updated field, whose remainder alone is fixed: packets by remainder, and whether all are inside and in all tenths of the range."""
    out = synthetic.random_update(packets(spark, d), "src_port", 3000, 500, n=3, k=1)
    own = F.col("src_port") - 3000
    return out.groupBy((own % 3).cast("long").alias("residue")).agg(F.count(F.lit(1)).alias("packets"), F.bool_and(own.between(1, 506)).alias("inside"), F.count_distinct(F.floor(F.least(own, F.lit(499)) / 50)).alias("tenths"))


@query
def known_ports_table(spark, d):
    return rules.known_ports(spark)


@query
def link_types_table(spark, d):
    return rules.link_types(spark)


@query
def map_catalog(spark, d):
    return state.catalog(spark)


@query
def string_functions(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("s"))
    s = F.col("s")
    wide = F.concat(F.lit(" \t"), s, F.lit(" \n"))
    return p.select(
        "p_partkey",
        S.mid(s, 1, 3).alias("mid"),
        S.delete(s, 1, 2).alias("deleted"),
        S.insert(s, 2, F.lit("--")).alias("inserted"),
        S.find(s, F.lit("a")).alias("found"),
        S.find_last(s, F.lit("a")).alias("last"),
        S.find_any(s, "xyz ").alias("any_of"),
        S.pattern(F.substring(s, 1, 2), 5).alias("pat"),
        S.join(S.split(s, " "), "+").alias("joined"),
        S.compare(s, F.lit("m")).alias("cmp"),
        S.trimmed(wide).alias("trimmed"),
        F.length(S.trimmed(wide, right=False)).alias("left_trimmed"),
        S.formatted("%s/%05d", s, F.col("p_partkey")).alias("formatted"),
        S.join(S.split_each(s, " ", F.reverse), "-").alias("each_reversed"),
    )


@query
def payload_scan(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length(match.scanned("text")).alias("scanned"))


@query
def packet_jitter(spark, d):
    return verdicts.jitter(packets(spark, d), ["src_ip"])


@query
def round_trip_times(spark, d):
    return verdicts.round_trips(both_ways(packets(spark, d)))


@query
def rate_limited(spark, d):
    return state.limited(packets(spark, d).select("pkt_id", "ts", "src_ip"), 5, 3600)


def dealt_query(kind: str) -> None:
    def f(spark, d):
        """Packets of a worker are in one partition."""
        out = verdicts.placed(packets(spark, d), kind, 16).withColumn("partition", F.spark_partition_id())
        return out.groupBy("worker").agg(F.count(F.lit(1)).alias("packets"), F.count_distinct("partition").alias("partitions"))

    f.__name__ = f"dealt_{kind}"
    query(f)


for _kind in ("hashing", "balanced"):
    dealt_query(_kind)


@query
def idle_sessions(spark, d):
    return verdicts.sessions(packets(spark, d), ["src_ip"], "1 hour").select("src_ip", "started", "packets")


@query
def throughput_by_hour(spark, d):
    return verdicts.throughput(packets(spark, d), 3600)


@query
def concurrency_stats(spark, d):
    h = packets(spark, d).groupBy("ts").agg(F.count(F.lit(1)).alias("active")).groupBy("active").agg(F.count(F.lit(1)).alias("n"))
    return verdicts.weighted_median(h, "active", "n")


@query
def frame_decode(spark, d):
    """Packets written as frames and read back from their bytes."""
    out = decode_frames(as_frames(packets(spark, d)))
    return out.select("pkt_id", "eth_type", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "tcp_flags", "ttl", "df", "pkt_len", "packet_bytes", "payload_len", "seq")


@query
def packet_kinds(spark, d):
    return packets(spark, d).groupBy(flags.kind().alias("kind"), "proto").agg(F.count(F.lit(1)).alias("packets"))


@query
def tcp_quirks(spark, d):
    p = packets(spark, d).where("proto = 6").select("pkt_id", "tcp_flags", (F.col("pkt_id") % 3).alias("seq"), (F.col("pkt_id") % 4).alias("ack"), (F.col("pkt_id") % 2).alias("urg"))
    return p.select("pkt_id", flags.quirks(flags.SYN).cast("int").alias("syn"), flags.quirks(flags.FIN).cast("int").alias("fin"))


@query
def tcp_fingerprint(spark, d):
    """Option bytes of three kinds read, and the fingerprint text of each packet."""
    raw = F.when(F.col("pkt_id") % 3 == 0, F.unhex(F.lit("020405b40402080a000000050000000001030307"))).when(F.col("pkt_id") % 3 == 1, F.unhex(F.lit("020405b4")))
    p = packets(spark, d).where("proto = 6").select("pkt_id", tcp_options.decode_options(raw).alias("o"), F.when(F.col("pkt_id") % 2 == 0, 5840).otherwise(1000).alias("wsize"), F.lit(64).alias("ttl"), F.lit(1).alias("df"), (F.col("pkt_id") % 120).cast("int").alias("size"))
    return p.select("pkt_id", "o.*", "wsize", "ttl", "df", "size").select("pkt_id", tcp_options.fingerprint_text().alias("fingerprint"))


@query
def home_net(spark, d):
    return packets(spark, d).where(keys.in_net("src_ip", "10.0.0.0/28") | keys.in_net("dst_ip", "192.168.0.64/27")).select("pkt_id", "src_ip", "dst_ip")


@query
def enabled_checks(spark, d):
    return packets(spark, d).where(keys.all_set(F.col("tcp_flags"), 0x18)).groupBy("tcp_flags").agg(F.count(F.lit(1)).alias("packets"))


@query
def state_lookup(spark, d):
    """All packets look at what UDP packets have counted, which other destinations don't have."""
    p = packets(spark, d)
    table = p.where("proto = 17").groupBy("dst_ip").agg(F.count(F.lit(1)).alias("seen"))
    return state.looked_up(p.select("pkt_id", "dst_ip"), table, ["dst_ip"])


@query
def stale_counter(spark, d):
    return state.stale(packets(spark, d).select("pkt_id", "ts", "dst_ip"), ["dst_ip"], 86_400).select("pkt_id", "stale")


@query
def first_match_per_connection(spark, d):
    p = both_ways(packets(spark, d)).select("pkt_id", "ts", "tcp_flags", *keys.sym_flow())
    return state.once(p, list(keys.SYM), F.col("tcp_flags") == 24).select(*keys.SYM, "pkt_id")


@query
def ordered_state(spark, d):
    return counters.by_port(packets(spark, d), "dst_port").orderBy("port").select("port", "packets")


@query
def flow_context(spark, d):
    """The first sequence number and all bytes of each directed flow."""
    p = packets(spark, d).where("proto = 6")
    return p.groupBy(*keys.FLOW).agg(F.min_by("pkt_id", F.struct("ts", "pkt_id")).alias("init_seq"), F.sum("pkt_len").cast("long").alias("total_bytes"))


@query
def forwarded_packets(spark, d):
    """What the protocol filter lets through, read back from files."""
    folder = new_folder(spark, "forwarded")
    verdicts.forward_to(verdicts.routed(packets(spark, d), F.when(F.col("proto") == 6, 1).otherwise(0)), folder)
    return spark.read.parquet(folder).select("pkt_id", "proto", "verdict")
