"""Packet tables: the view of the events table as packets, frames as bytes, a stream of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: bytes of a frame that are looked at.
SNAPSHOT = 1604

CLIENT_NET, SERVER_NET = 167_772_160, 3_232_235_520  # 10.0.0.0 and 192.168.0.0


def as_packets(events: DataFrame) -> DataFrame:
    """Rows of events as packets from clients in 10.0.0.0 to servers in 192.168.0.0; addresses are unsigned, so bigint."""
    k = F.get_json_object("props", "$.k").cast("long")
    port = F.element_at(F.array(*map(F.lit, (80, 443, 22, 53, 8080))), (k % 5 + 1).cast("int"))
    flags = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 17).when(F.col("event_type") == "view", 16).otherwise(24)
    return events.select(
        F.col("event_id").alias("pkt_id"),
        "ts",
        (F.lit(CLIENT_NET) + F.col("user_id")).cast("long").alias("src_ip"),
        (F.lit(SERVER_NET) + k).cast("long").alias("dst_ip"),
        (F.lit(10001) + F.col("user_id") % 7).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"),
        F.when(k % 5 == 3, 17).otherwise(6).cast("int").alias("proto"),
        flags.cast("int").alias("tcp_flags"),
        F.round(F.col("value") * 100).cast("long").alias("pkt_len"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(spark.read.parquet(f"{sf_dir}/events.parquet"))


def both_ways(df: DataFrame) -> DataFrame:
    """Packets with odd pkt_id turned round, so that flows have two directions."""
    odd = F.col("pkt_id") % 2 == 1

    def turned(a: str, b: str) -> list[Column]:
        return [F.when(odd, F.col(b)).otherwise(F.col(a)).alias(a), F.when(odd, F.col(a)).otherwise(F.col(b)).alias(b)]

    return df.select("pkt_id", "ts", *turned("src_ip", "dst_ip"), *turned("src_port", "dst_port"), "proto", "tcp_flags", "pkt_len")


def packet_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """Packets as a stream from event files; ts as an instant, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parquet*")
    return as_packets(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def number(frame: Column, at: Column, size: int) -> Column:
    """The unsigned big-endian number of size bytes that begins at byte at (from 0)."""
    return F.conv(F.hex(F.substring(frame, at + 1, F.lit(size))), 16, 10).cast("long")


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Columns of Ethernet frames: VLAN tags of one or two levels are skipped, IPv4 and its TCP or UDP header are read. Fields that a frame doesn't have are null. Snapshots end at SNAPSHOT bytes; captured tells how many there are."""
    f = F.substring(F.col(frame), F.lit(1), F.lit(SNAPSHOT))
    outer = number(f, F.lit(12), 2)
    tagged, inner = outer.isin(0x8100, 0x88A8, 0x9100), number(f, F.lit(16), 2)
    base = F.when(tagged & (inner == 0x8100), 22).when(tagged, 18).otherwise(14)
    step = df.withColumn("_l3", base.cast("int"))
    kind = number(f, F.col("_l3") - 2, 2)
    step = step.withColumn("captured", F.length(f)).withColumn("eth_type", kind).withColumn("vlan", F.when(tagged, number(f, F.lit(14), 2).bitwiseAND(F.lit(0xFFF))))
    ip4 = (F.col("eth_type") == 0x0800) & (F.length(f) >= F.col("_l3") + 20)
    step = step.withColumn("_ihl", F.when(ip4, number(f, F.col("_l3"), 1).bitwiseAND(F.lit(15)) * 4).cast("int"))
    at = F.col("_l3")
    step = step.withColumns(
        {
            "pkt_len": F.when(ip4, number(f, at + 2, 2)),
            "ttl": F.when(ip4, number(f, at + 8, 1)),
            "df": F.when(ip4, F.shiftright(number(f, at + 6, 1), 6).bitwiseAND(F.lit(1))),
            "proto": F.when(ip4, number(f, at + 9, 1)),
            "src_ip": F.when(ip4, number(f, at + 12, 4)),
            "dst_ip": F.when(ip4, number(f, at + 16, 4)),
            "_l4": at + F.col("_ihl"),
        }
    )
    ported, tcp, at = F.col("proto").isin(6, 17), F.col("proto") == 6, F.col("_l4")
    step = step.withColumns(
        {
            "src_port": F.when(ported, number(f, at, 2)),
            "dst_port": F.when(ported, number(f, at + 2, 2)),
            "seq": F.when(tcp, number(f, at + 4, 4)),
            "ack": F.when(tcp, number(f, at + 8, 4)),
            "_off": F.when(tcp, F.shiftright(number(f, at + 12, 1), 4) * 4).when(ported, F.lit(8)).cast("int"),
            "tcp_flags": F.when(tcp, number(f, at + 13, 1)),
            "win": F.when(tcp, number(f, at + 14, 2)),
        }
    )
    step = step.withColumns({"packet_bytes": F.col("pkt_len") - F.col("_ihl"), "payload_len": F.col("pkt_len") - F.col("_ihl") - F.col("_off"), "tcp_options": F.when(tcp, F.substring(f, F.col("_l4") + 21, F.col("_off") - 20))})
    return step.drop("_l3", "_l4", "_ihl", "_off")


def hexed(value: Column, size: int) -> Column:
    """A number as hex digits of so many bytes."""
    return F.lpad(F.hex(value), 2 * size, "0")


def as_frames(df: DataFrame) -> DataFrame:
    """pkt_id, frame: Ethernet frames with the headers of packets (no payload; lengths of more than two bytes are cut to 65535)."""
    tcp = F.col("proto") == 6
    ip = [F.lit("4500"), hexed(F.least(F.col("pkt_len"), F.lit(65535)), 2), F.lit("00004000"), F.lit("40"), hexed(F.col("proto"), 1), F.lit("0000"), hexed(F.col("src_ip"), 4), hexed(F.col("dst_ip"), 4)]
    ports = [hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2)]
    rest = F.when(tcp, F.concat(hexed(F.pmod("pkt_id", F.lit(1 << 32)), 4), F.lit("0" * 8), F.lit("50"), hexed(F.col("tcp_flags"), 1), F.lit("16d000000000"))).otherwise(F.lit("00080000"))
    return df.select("pkt_id", F.unhex(F.concat(F.lit("0" * 24), F.lit("0800"), *ip, *ports, rest)).alias("frame"))


#: IP protocols that mixed_frames() takes turns with.
OTHER_PROTOCOLS = (1, 4, 41, 47, 50)


def mixed_frames(df: DataFrame) -> DataFrame:
    """pkt_id, ts, frame: frames of all sorts from the addresses and ports of packets, by turns of eight.

    0 and 7: plain ones; 1: with a VLAN tag; 2: with two; 3: ARP; 4: IPv6; 5: other IP protocols;
    6: another ether type. IPv4 frames have 0 to 1799 bytes of payload, every third none.
    """
    turn = F.col("pkt_id") % 8
    vid = hexed(F.pmod("src_ip", F.lit(4094)) + 1, 2)
    tag = F.when(turn == 1, F.concat(F.lit("8100"), vid)).when(turn == 2, F.concat(F.lit("88a80064"), F.lit("8100"), vid)).otherwise("")
    ether = F.when(turn == 3, "0806").when(turn == 4, "86dd").when(turn == 6, "88cc").otherwise("0800")
    proto = F.when(turn == 5, F.element_at(F.array(*map(F.lit, OTHER_PROTOCOLS)), (F.floor(F.col("pkt_id") / 8) % 5 + 1).cast("int"))).otherwise(F.col("proto"))
    tcp = proto == 6
    payload = F.when(F.col("pkt_id") % 3 == 0, 0).otherwise((F.col("pkt_id") * 37) % 1800).cast("int")
    header = F.when(tcp, 20).otherwise(8)
    ip = F.concat(F.lit("4500"), hexed(F.lit(20) + header + payload, 2), F.lit("0000400040"), hexed(proto, 1), F.lit("0000"), hexed(F.col("src_ip"), 4), hexed(F.col("dst_ip"), 4))
    ports = F.concat(hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2))
    rest = F.when(tcp, F.concat(hexed(F.pmod("pkt_id", F.lit(1 << 32)), 4), F.lit("0" * 8), F.lit("50"), hexed(F.col("tcp_flags"), 1), F.lit("16d000000000"))).otherwise(F.lit("00080000"))
    body = F.when(turn.isin(3, 4, 6), F.lit("00" * 46)).otherwise(F.concat(ip, ports, rest, F.repeat(F.lit("00"), payload)))
    return df.select("pkt_id", "ts", F.unhex(F.concat(F.lit("0" * 24), tag, ether, body)).alias("frame"))
