"""A stream over the same packets gives the rows of the batch query."""

import shutil
from datetime import timedelta
from pathlib import Path

from pyspark.sql import functions as F

from weirflow.functions.keys import FLOW, SYM
from weirflow.operators import flows, state, verdicts
from weirflow.sources.packets import both_ways, packet_stream, packets
from weirflow.streaming import processors

DATA = "/root/testdata/sf0.001"


def parts(spark, tmp_path):
    """The events in three files, in order."""
    e = spark.read.parquet(f"{DATA}/events.parquet")
    n = e.count()
    folder = tmp_path / "in"
    (folder / "events.parquet").mkdir(parents=True)
    for k in range(3):
        e.orderBy("ts", "event_id").offset(n * k // 3).limit(n * (k + 1) // 3 - n * k // 3).coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    return str(folder)


def test_generations(spark, tmp_path):
    folder = parts(spark, tmp_path)
    done = processors.run_to(processors.generations(packet_stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "c"))
    want = state.with_generations(packets(spark, DATA), list(FLOW)).select("pkt_id", "version", "created")
    assert len(done) >= 3 and sum(p["numInputRows"] for p in done) == want.count()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_counts_in_batches(spark, tmp_path):
    folder = parts(spark, tmp_path)
    processors.run_changes(processors.count_by(packet_stream(spark, folder), "src_ip"), str(tmp_path / "out"), str(tmp_path / "c"))
    out = processors.latest(spark, str(tmp_path / "out"), ["src_ip"])
    want = packets(spark, DATA).groupBy("src_ip").agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_connections_in_batches(spark, tmp_path):
    folder = parts(spark, tmp_path)
    processors.run_changes(processors.connections(both_ways(packet_stream(spark, folder))), str(tmp_path / "out"), str(tmp_path / "c"))
    out = processors.latest(spark, str(tmp_path / "out"), [*SYM, "version"])
    want = flows.connections(both_ways(packets(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp")))).select(out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Files that come after the first run, in a second run: state and rows go on, nothing is there twice."""
    whole = Path(parts(spark, tmp_path)) / "events.parquet"
    files = sorted(whole.glob("*.parquet"), key=lambda p: spark.read.parquet(str(p)).agg(F.min("ts")).first()[0])
    later = tmp_path / "later"
    later.mkdir()
    for f in files[1:]:
        shutil.move(f, later / f.name)

    def run():
        processors.run_to(processors.stale(packet_stream(spark, str(whole.parent)).select("pkt_id", "ts", "dst_ip"), "dst_ip", 86_400), str(tmp_path / "out"), str(tmp_path / "c"))
        return spark.read.parquet(str(tmp_path / "out")).count()

    first = run()
    for f in files[1:]:
        shutil.move(later / f.name, f)
    want = state.stale(packets(spark, DATA).select("pkt_id", "ts", "dst_ip"), ["dst_ip"], 86_400).select("pkt_id", "stale")
    assert 0 < first < run() == want.count()
    assert run() == want.count()  # nothing new
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_sessions_run(spark, tmp_path):
    processors.run_to(processors.idle_sessions(packet_stream(spark, DATA), "src_ip", idle="1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    out = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("src_ip", "started", "packets").collect()}
    p = packets(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    want = verdicts.sessions(p, ["src_ip"], "1 hour").select("src_ip", "started", "packets")
    past = p.agg(F.max("ts")).first()[0] - timedelta(minutes=71)  # what the watermark has surely passed
    assert out <= {tuple(r) for r in want.collect()} and {tuple(r) for r in want.where(F.col("started") < F.lit(past)).collect() if r.packets == 1} <= out
