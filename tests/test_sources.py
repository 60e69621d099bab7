"""Files of rules and signatures, frames as bytes, options, generators."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from weirflow.functions import flags, strings, tcp_options
from weirflow.operators import match
from weirflow.sources import rules, synthetic
from weirflow.sources.packets import decode_frames


def wrote(tmp_path, text):
    path = tmp_path / "rules"
    path.write_text(text)
    return str(path)


def test_ids_rules(spark, tmp_path):
    path = wrote(tmp_path, '# none\nalert tcp any any -> any 80 (content:"evil"; content:"other";)\n\nalert (pcre:"/ev[i1]l/i";)\nalert (msg:"x";)\nalert (content:"GET";)\n')
    table = rules.ids_rules(spark, path)
    assert [tuple(r) for r in table.orderBy("rule_id").collect()] == [(1, "evil", None), (2, None, "(?i)ev[i1]l"), (3, "GET", None)]
    got = match.first_rule(spark.createDataFrame([("GET /evil",), ("ev1l",), ("GET /",), ("hello",), (None,)], "t string"), "t", table)
    assert [r.matched for r in got.collect()] == [1, 2, 3, None, None]


def test_service_signatures(spark, tmp_path):
    table = rules.service_signatures(spark, wrote(tmp_path, "www,v/SampleHTTPD/$1//,Server: Sample/([0-9.]+), x\n#c\nssh,v/SSH//a,b/,SSH-\n"))
    got = table.orderBy("sig_id").collect()
    assert (got[0].sig_id, got[0].service, got[0].app, got[0].version, got[0].regex) == (0, "www", "SampleHTTPD", "$1", "Server: Sample/([0-9.]+), x")
    hit = match.services(spark.createDataFrame([("Server: Sample/1.2, x",)], "p string"), "p", table.limit(1)).first()
    assert (hit.sig_id, hit.title) == (0, "SampleHTTPD 1.2")


def test_vendors(spark, tmp_path):
    table = rules.mac_vendors(spark, wrote(tmp_path, "02:FE:00 Sample # test\n02:FE:00:80:00:00/25 Half\n02 All\n"))
    macs = spark.createDataFrame([("02:fe:00:7f:00:00",), ("02:FE:00:80:00:01",), ("02-00-00-00-00-00",), ("03:00:00:00:00:00",)], "m string")
    assert [r.vendor for r in match.longest_prefix(macs, "m", table).orderBy("m").collect()] == ["All", "Half", "Sample", None]


def test_config(spark, tmp_path):
    got = rules.config(spark, wrote(tmp_path, "a=1\nb = x=y # c\na=2\nnone\n")).collect()
    assert {r.key: r.value for r in got} == {"a": "2", "b": "x=y"}


def test_os_signatures(spark, tmp_path):
    table = rules.os_signatures(spark, wrote(tmp_path, "S4:64:1:60:M1460,S,T,N,W7:.:SampleOS:kernel A\n"))
    row = table.first()
    assert (row.win_mode, row.win, row.opts, row.mss, row.mss_mod, row.wscale, row.zero_stamp, row.quirks, row.genre) == ("mss", 4, [2, 4, 8, 1, 3], 1460, False, 7, False, 0, "SampleOS")
    base = {"size": 60, "optcnt": 5, "opts": [2, 4, 8, 1, 3], "mss": 1460, "wscale": 7, "wsize": 5840, "ttl": 60, "df": 1, "quirks": 0, "tstamp": 9}
    cases = [base, base | {"wsize": 5841}, base | {"ttl": 65}, base | {"tstamp": 0}, base | {"df": 0}]
    packets = spark.createDataFrame([(k, *c.values()) for k, c in enumerate(cases)], "pkt_id int, size int, optcnt int, opts array<int>, mss int, wscale int, wsize int, ttl int, df int, quirks int, tstamp int")
    assert [r.sig_id for r in match.systems(packets, table).orderBy("pkt_id").collect()] == [0, None, None, None, 0]


def frame(vlan=b"", options=b"\x02\x04\x05\xb4\x01\x01\x04\x02", payload=b"hello world"):
    tcp = struct.pack(">HHIIBBHHH", 1000, 80, 7, 9, (20 + len(options)) // 4 << 4, 18, 5840, 0, 0) + options
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(tcp) + len(payload), 1, 0x4000, 64, 6, 0, 167772161, 3232235521)
    return b"\0" * 12 + vlan + b"\x08\0" + ip + tcp + payload


@pytest.mark.parametrize("vlan", [b"", b"\x81\0\0\x05", b"\x88\xa8\0\x05\x81\0\0\x06"])
def test_frames(spark, vlan):
    row = decode_frames(spark.createDataFrame([(bytearray(frame(vlan)),), (bytearray(b"\0" * 12 + b"\x08\x06" + b"\0" * 28),), (None,)], "frame binary")).collect()
    got = row[0]
    assert (got.src_ip, got.dst_ip, got.src_port, got.dst_port, got.proto, got.tcp_flags, got.ttl, got.df, got.payload_len, got.win, got.vlan) == (167772161, 3232235521, 1000, 80, 6, 18, 64, 1, 11, 5840, 5 if vlan else None)
    assert bytes(got.tcp_options) == b"\x02\x04\x05\xb4\x01\x01\x04\x02"
    assert row[1].src_ip is None and row[1].eth_type == 0x0806


def test_options(spark):
    raw = [b"\x02\x04\x05\xb4\x04\x02\x08\x0a\0\0\0\x05\0\0\0\0\x01\x03\x03\x07", b"", b"\x02\x04\x05", b"\0\0"]
    d = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(raw)], "k int, raw binary").select("k", tcp_options.decode_options("raw").alias("o")).select("k", "o.*")
    got = d.orderBy("k").collect()
    assert got[0].opts == [2, 4, 8, 1, 3] and (got[0].mss, got[0].wscale, got[0].tstamp, got[0].quirks) == (1460, 7, 5, 0)
    assert got[1].opts == [] and got[2].quirks == 512 and got[3].quirks == 1
    text = d.where("k = 0").withColumns({"wsize": F.lit(5840), "ttl": F.lit(64), "df": F.lit(1), "size": F.lit(60)}).select(tcp_options.fingerprint_text().alias("t")).first().t
    assert text == "S4:64:1:60:M1460,S,T,N,W7:."


def read_options(data):
    """Numbers of the options in order, mss, wscale, time stamp and quirk bits, a byte after the other."""
    opts, mss, wscale, tstamp, quirks, at = [], 0, 0, 0, 0, 0
    while at < len(data):
        kind, rest = data[at], data[at + 1 :]
        size = {0: 0, 1: 0, 2: 3, 3: 2, 4: 1, 8: 9}.get(kind, rest[0] - 1 if rest else -1)
        if size < 0 or size > min(32, len(rest)) or len(opts) == 15:
            quirks |= 512
            break
        if kind == 0 and rest:
            quirks |= 1
        elif kind == 2:
            mss = int.from_bytes(rest[1:3], "big")
        elif kind == 3:
            wscale = rest[1]
        elif kind == 8:
            tstamp = int.from_bytes(rest[1:5], "big")
            quirks |= 64 if any(rest[5:9]) else 0
        opts.append(kind)
        at += 1 + size
    return opts, mss, wscale, tstamp, quirks


def test_options_byte_by_byte(spark):
    r = random.Random(4)
    raw = [bytes(r.choice([0, 1, 2, 3, 4, 8, 4, 10, 2, 3, r.randrange(256)]) for _ in range(r.randint(0, 40))) for _ in range(600)] + [b"\x01" * 20]
    d = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(raw)] + [(-1, None)], "k int, raw binary").select("k", tcp_options.decode_options("raw").alias("o")).select("k", "o.*")
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    got = {x.k: (x.opts, x.mss, x.wscale, x.tstamp, x.quirks) for x in d.collect()}
    assert got.pop(-1) == ([], 0, 0, 0, 0) and all(got[k] == read_options(x) for k, x in enumerate(raw))
    text = d.where("k = -1").withColumns({"wsize": F.lit(7), "ttl": F.lit(64), "df": F.lit(1), "size": F.lit(60)})
    assert text.select(tcp_options.fingerprint_text("ack").alias("t")).first().t == "7:64:1:*:E,E,E:."


def test_quirks(spark):
    d = spark.createDataFrame([(18, 0, 0, 0), (20, 5, 7, 1)], "tcp_flags int, seq long, ack long, urg int")
    assert [r.q for r in d.select(flags.quirks(flags.SYN).alias("q")).collect()] == [2048 | 4096, 32 | 8]


def test_generator(spark):
    d = synthetic.flows(spark, 200, pps=200, flow_rate=10, arrival="exponential", durations="pareto", n=3, k=1).cache()
    per = d.groupBy("flow_id").agg(F.min_by("tcp_flags", "nth").alias("a"), F.max_by("tcp_flags", "nth").alias("z"), F.count("*").alias("n")).collect()
    assert len(per) == 200 and all(r.a & 2 and r.z & 1 for r in per)
    assert {r.src_ip - 167772160 for r in d.collect()} == {1, 4, 7}
    assert d.exceptAll(synthetic.flows(spark, 200, pps=200, flow_rate=10, arrival="exponential", durations="pareto", n=3, k=1)).count() == 0
    with pytest.raises(ValueError):
        synthetic.flows(spark, 1, pps=1, flow_rate=2)


def test_strings(spark):
    s = F.col("s")
    d = spark.createDataFrame([("abcabc",)], "s string").select(
        strings.find(s, F.lit("c"), 3).alias("a"), strings.find(s, F.lit("x")).alias("b"), strings.find_last(s, F.lit("bc")).alias("c"), strings.find_any(s, "cx").alias("d"), strings.find_none(s, "ab").alias("e"),
        strings.replace_at(s, 1, 2, F.lit("Z")).alias("f"), strings.pattern(s, 8).alias("g"), strings.find_replace_caseless(s, "BC", "$1").alias("h"), strings.app_title(F.lit("x"), F.lit(""), F.lit("m")).alias("i"), strings.split(F.lit("a.b"), ".").alias("j"),
    ).first()
    assert tuple(d) == (5, -1, 4, 2, 2, "aZabc", "abcabcab", "a$1a$1", "x (m)", ["a", "b"])
