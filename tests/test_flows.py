"""The nine packets of FIXTURES.md, invariants, and state machines in plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.functions import keys
from weirflow.operators import counters, flows, match, nat, reassembly, state, verdicts
from weirflow.sources.packets import packets

A, B, C = 167772161, 3232235521, 167772162
NINE = [
    (1, 0, A, B, 10001, 80, 6, 2, 60), (2, 1, B, A, 80, 10001, 6, 18, 60), (3, 2, A, B, 10001, 80, 6, 24, 1500),
    (4, 3, C, B, 10002, 53, 17, 0, 200), (5, 4, A, B, 10001, 80, 6, 17, 60), (6, 5, A, B, 10001, 80, 6, 2, 60),
    (7, 6, 167772166, 3232235522, 10003, 443, 6, 2, 4000), (8, 7, 167772166, 3232235522, 10003, 443, 6, 24, 1500), (9, 8, 167772166, 3232235522, 10003, 443, 6, 24, 700),
]


@pytest.fixture(scope="module")
def nine(spark):
    rows = [(r[0], datetime(2024, 1, 1) + timedelta(seconds=r[1]), *r[2:]) for r in NINE]
    return spark.createDataFrame(rows, "pkt_id long, ts timestamp, src_ip long, dst_ip long, src_port int, dst_port int, proto int, tcp_flags int, pkt_len long")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_counters(nine):
    assert rows(counters.by_ip(nine, "src_ip"), "ip", "packets", "bytes") == [(A, 4, 1680), (C, 1, 200), (167772166, 3, 6200), (B, 1, 60)]
    assert rows(counters.by_ip(nine, "dst_ip"), "ip", "packets") == [(A, 1), (B, 5), (3232235522, 3)]
    assert rows(counters.by_subnet(nine, "src_ip", 30), "subnet", "packets", "charged") == [(41943040, 5, 320), (41943041, 3, 192), (808058880, 1, 64)]


def test_generations(nine):
    got = dict(rows(state.with_generations(nine, list(keys.FLOW)), "pkt_id", "version"))
    assert got == {k: int(k == 6) for k in range(1, 10)}


def test_connections(nine):
    got = rows(flows.connections(nine), "a_ip", "b_ip", "a_port", "b_port", "version", "s_pkts", "d_pkts", "s_bytes", "d_bytes", "s_flags", "d_flags")
    assert got == [(A, B, 10001, 80, 0, 3, 1, 1620, 60, 27, 18), (A, B, 10001, 80, 1, 1, 0, 60, 0, 2, 0), (C, B, 10002, 53, 0, 1, 0, 200, 0, 0, 0), (167772166, 3232235522, 10003, 443, 0, 3, 0, 6200, 0, 26, 0)]


def test_answered_connections_turn(nine):
    got = {(r.a_ip, r.version): (r.reversed, r.s_pkts, r.d_pkts) for r in flows.turned(nine).collect()}
    assert got[(A, 0)] == (True, 1, 3) and got[(A, 1)] == (False, 1, 0)


def test_quota(nine):
    assert rows(state.gated(nine, ["src_ip"], "pkt_len", 5000).where("not admitted"), "pkt_id", "prior") == [(9, 5500)]


def test_locality(nine):
    got = dict(rows(nine.select("pkt_id", keys.locality().alias("h")), "pkt_id", "h"))
    assert (got[1], got[2], got[7]) == (372, 372, 378)


def test_verdicts(nine):
    assert {r.verdict for r in verdicts.routed(nine, F.lit(-1)).collect()} == {"forward"}
    assert {r.verdict for r in verdicts.routed(nine, F.lit(0)).collect()} == {"drop"}


def test_reassembly(spark):
    d = spark.createDataFrame([(1, s, a) for s, a in ((1, 1), (3, 2), (4, 3), (2, 4), (5, 5), (7, 6), (6, 7))], "flow int, seq int, arrival int")
    out = {r.seq: (r.release, r.buffered) for r in reassembly.released(d, ["flow"]).collect()}
    assert {k: v[0] for k, v in out.items()} == {1: 1, 2: 4, 3: 4, 4: 4, 5: 5, 6: 7, 7: 7}
    assert {k for k, v in out.items() if v[1]} == {3, 4, 7}
    assert rows(reassembly.occupancy(d, ["flow"]), "n_buffered", "peak", "overflow") == [(3, 2, False)]


def test_reassembly_as_a_machine(spark):
    r = random.Random(3)
    given, want = [], {}
    for flow in range(20):
        order = list(range(1, 12))
        r.shuffle(order)
        held, following = set(), 1
        for at, seq in enumerate(order, 1):
            given.append((flow, seq, at))
            held.add(seq)
            while following in held:
                want[(flow, following)] = at
                following += 1
    d = spark.createDataFrame(given, "flow int, seq int, arrival int")
    assert {(x.flow, x.seq): x.release for x in reassembly.released(d, ["flow"]).collect()} == want


def test_generations_as_a_machine(spark):
    p = packets(spark, "/root/testdata/sf0.001").cache()
    versions, want = {}, {}
    for x in p.orderBy("ts", "pkt_id").collect():
        key = (x.src_ip, x.dst_ip, x.src_port, x.dst_port)
        want[x.pkt_id] = versions.get(key, 0)
        if x.proto == 6 and x.tcp_flags & 5:
            versions[key] = versions.get(key, 0) + 1
    assert dict(rows(state.with_generations(p, list(keys.FLOW)), "pkt_id", "version")) == want


def test_sums_and_partitions(spark):
    p = packets(spark, "/root/testdata/sf0.001")
    n = p.count()
    assert counters.report(counters.by_ip(p, "src_ip")).first().total == n
    many = rows(flows.connections(p.repartition(13)), "a_ip", "b_ip", "a_port", "b_port", "version", "s_pkts")
    assert many == rows(flows.connections(p), "a_ip", "b_ip", "a_port", "b_port", "version", "s_pkts") and sum(x[-1] for x in many) == n


def test_ports_run_out(spark, monkeypatch):
    monkeypatch.setattr(nat, "LAST_PORT", nat.FIRST_PORT + 9)
    t = nat.table(packets(spark, "/root/testdata/sf0.001"))
    ports = [r.new_port for r in t.collect()]
    assert sorted(x for x in ports if x) == list(range(nat.FIRST_PORT, nat.FIRST_PORT + 10)) and ports.count(None) == len(ports) - 10


def test_translation_comes_back(spark, nine):
    table = nat.entries(nat.table(nine)).collect()
    ahead = {(r.src_ip, r.dst_ip, r.src_port, r.dst_port): r for r in table if r.is_forward}
    for r in table:
        if not r.is_forward:
            own = ahead[(r.new_ip, r.src_ip, r.new_port, r.src_port)]
            assert (own.new_ip, own.new_port) == (r.dst_ip, r.dst_port)


def test_empty_table(nine):
    none = nine.limit(0)
    assert counters.report(counters.by_ip(none, "src_ip")).first().total == 0
    assert flows.turned(none).count() == flows.tcp_flows(none).count() == nat.table(none).count() == 0


def machine(rows):
    """(prior count, previous number) of each packet of a key, in plain Python."""
    out, seen = {}, {}
    for n, _, key in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[0]) if r[1] else (False, datetime.min, r[0])):
        out[n] = (len(seen.setdefault(key, [])), seen[key][-1] if seen[key] else None)
        seen[key].append(n)
    return out


def test_state_keeps_columns_and_hot_keys(spark):
    """Names of the input that operators use themselves, null keys and times, a key with most packets, over many slices."""
    r = random.Random(7)
    given = [(n, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(40_000)) if n % 17 else None, None if n % 29 == 0 else (1 if n % 3 else n % 50)) for n in range(2000)]
    d = spark.createDataFrame([(*x, "p", "l", 1, 2, 3, "f") for x in given], "pkt_id long, ts timestamp, k int, last string, _slice string, part int, v int, total int, found string")
    want = machine(given)
    known = state.seen_before(d, ["k"])
    assert known.columns == [*d.columns, "known"] and {x.pkt_id: x.known for x in known.collect()} == {n: p > 0 for n, (p, _) in want.items()}
    before = state.previous(d, ["k"], F.col("pkt_id"), "before").collect()
    assert {x.pkt_id: x.before for x in before} == {n: b for n, (_, b) in want.items()}
    run = state.running(d, ["k"], F.lit(1), "n").collect()
    assert {x.pkt_id: x.n for x in run} == {n: p + 1 for n, (p, _) in want.items()} and run[0].last == "p"
    versions = state.with_generations(d.withColumns({"prior": F.lit("x"), "proto": F.lit(6), "tcp_flags": F.lit(1)}), ["k"])
    assert {x.pkt_id: x.version for x in versions.collect()} == {n: p for n, (p, _) in want.items()} and "prior" in versions.columns
    with pytest.raises(ValueError):
        state.gated(d.withColumn("prior", F.lit(1)), ["k"], "v", 5)
    once = state.once(d, ["k"], F.col("pkt_id") > 100)
    assert once.count() == len({k for n, _, k in given if n > 100})


def test_reassembly_of_one_long_flow(spark, monkeypatch):
    monkeypatch.setattr(reassembly, "SLICE", 16)
    r = random.Random(5)
    order = sorted(range(1, 900), key=lambda s: s + r.randint(0, 60))
    given = [("a", s, k + 1) for k, s in enumerate(order)] + [(None, s, k + 1) for k, s in enumerate([3, 1, 2])]
    d = spark.createDataFrame(given, "flow string, seq int, arrival int").withColumn("most", F.lit(0))
    arrival = {(f, s): a for f, s, a in given}
    want = {(f, s): max(arrival[f, t] for t in range(1, s + 1)) for f, s, _ in given}
    assert {(x.flow, x.seq): x.release for x in reassembly.released(d, ["flow"]).collect()} == want
    peak = {}
    for f in ("a", None):
        spans = [(arrival[k], want[k]) for k in want if k[0] == f and want[k] > arrival[k]]
        peak[f] = (len(spans), max(sum(a <= t < b for a, b in spans) for t in range(1, 900)))
    assert {x.flow: (x.n_buffered, x.peak) for x in reassembly.occupancy(d, ["flow"]).collect()} == peak


def test_more_rules_than_one_expression_has(spark, monkeypatch):
    monkeypatch.setattr(match, "RULES_AT_ONCE", 3)
    rules = spark.createDataFrame([(k, f"w{k} ", None) for k in range(1, 11)], "rule_id int, content string, regex string")
    d = spark.createDataFrame([(k, " ".join(f"w{j} " for j in range(k, 20))) for k in range(1, 13)], "k int, t string")
    assert {x.k: x.matched for x in match.first_rule(d, "t", rules).collect()} == {k: k if k <= 10 else None for k in range(1, 13)}


def test_rate_limit(nine):
    assert rows(state.limited(nine, 2, 4), "pkt_id") == [(1,), (2,), (5,), (6,), (9,)]


def test_a_key_with_a_third_of_all_packets_is_split(spark):
    p = spark.range(60_000).select(
        F.col("id").alias("pkt_id"), (F.timestamp_seconds(F.col("id") * 12)).alias("ts"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("k"), F.col("id").alias("seq"), F.col("id").alias("arrival")
    )
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")

    def sizes(out, name):
        return sorted(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(name)).collect())

    try:
        for out, name in ((state.seen_before(p, ["k"]), "known"), (state.running(p, ["k"], F.lit(1), "n"), "n"), (state.previous(p, ["k"], F.col("pkt_id"), "b"), "b")):
            found = sizes(out, name)
            assert sum(found) == 60_000 and found[-1] <= 3 * found[len(found) // 2], found
        found = sizes(reassembly.released(p.withColumn("k", F.lit(1)), ["k"]), "release")
        assert sum(found) == 60_000 and found[-1] <= 4 * reassembly.SLICE, found  # some slices meet
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
