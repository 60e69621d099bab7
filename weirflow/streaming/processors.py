"""Keyed state over streams: counters as aggregates; generations, connections and stale reads as stateful processors; idle timeouts as session windows.

The rows of a micro-batch that share a key are sorted by (ts, pkt_id) before they touch the state,
so a batch query and a stream over the same packets in order give the same rows, however the
stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.keys import FLOW, SYM, forward, sym_flow

ENDS = 1 | 4  # FIN or RST


def count_by(stream: DataFrame, *keys) -> DataFrame:
    """packets and bytes by key, as they stand after each micro-batch."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("pkt_len").cast("long").alias("bytes"))


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a micro-batch, in order of arrival."""
    return pd.concat(batches).sort_values(["ts", "pkt_id"], ignore_index=True)


def ended(rows: pd.DataFrame) -> np.ndarray:
    """Which packets end their connection, as numbers."""
    return ((rows["proto"] == 6) & (rows["tcp_flags"] & ENDS != 0)).to_numpy().astype(np.int64)


def generations(stream: DataFrame) -> DataFrame:
    """pkt_id, version, created: the directed flow's state ends with FIN or RST and begins anew with the next packet."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, is_open = state.get if state.exists else (0, False)
        rows = in_order(batches)
        ends = ended(rows)
        created = np.concatenate([[not is_open], ends[:-1] == 1])
        versions = version + np.cumsum(ends) - ends
        state.update((int(version + ends.sum()), not ends[-1]))
        yield pd.DataFrame({"pkt_id": rows["pkt_id"], "version": versions, "created": created})

    return stream.groupBy(*FLOW).applyInPandasWithState(step, "pkt_id long, version long, created boolean", "version long, is_open boolean", "append", GroupStateTimeout.NoTimeout)


SIDES = [f"{side}_{what}" for what in ("pkts", "bytes", "flags") for side in ("s", "d")]


def connections(stream: DataFrame) -> DataFrame:
    """The table of connections of both directions as it grows: after each micro-batch, the rows of the generations it touched. A later row of a connection and version stands for the earlier ones."""
    keyed = stream.select("pkt_id", "ts", "proto", "tcp_flags", "pkt_len", "src_ip", "src_port", "dst_ip", "dst_port", *sym_flow(), forward().alias("ahead"))
    names = [*SYM, "version", "s_ip", "s_port", *SIDES, "start_time", "last_pkt_time"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = in_order(batches)
        held = state.get if state.exists else None
        ends = ended(rows)
        rows["version"] = (held[0] if held else 0) + np.cumsum(ends) - ends
        rows["flags"] = np.where(rows["proto"] == 6, rows["tcp_flags"], 0)
        out = []
        for version, own in rows.groupby("version", sort=True):
            first = own.iloc[0]
            if held and held[1] and held[0] == version:  # goes on from the state
                s_ahead, s_ip, s_port, start, sums = held[2], held[3], held[4], held[5], list(held[7:])
            else:
                s_ahead, s_ip, s_port, start, sums = bool(first["ahead"]), int(first["src_ip"]), int(first["src_port"]), first["ts"], [0] * 6
            for k, side in enumerate((own[own["ahead"] == s_ahead], own[own["ahead"] != s_ahead])):
                sums[k] += len(side)
                sums[2 + k] += int(side["pkt_len"].sum())
                sums[4 + k] |= int(np.bitwise_or.reduce(side["flags"].to_numpy(), initial=0))
            held = (int(version), True, s_ahead, s_ip, s_port, start, own["ts"].iloc[-1], *sums)
            out.append([*key, int(version), s_ip, s_port, *sums, start, own["ts"].iloc[-1]])
        if ends[-1]:
            held = (held[0] + 1, False, *held[2:])
        state.update(held)
        yield pd.DataFrame(out, columns=names)

    sums = "s_pkts long, d_pkts long, s_bytes long, d_bytes long, s_flags int, d_flags int"
    rows = f"a_ip long, b_ip long, a_port int, b_port int, version long, s_ip long, s_port int, {sums}, start_time timestamp, last_pkt_time timestamp"
    kept = f"version long, is_open boolean, ahead boolean, s_ip long, s_port int, start_time timestamp, last_pkt_time timestamp, {sums}"
    return keyed.groupBy(*SYM).applyInPandasWithState(step, rows, kept, "update", GroupStateTimeout.NoTimeout)


def stale(stream: DataFrame, key: str, seconds: int) -> DataFrame:
    """pkt_id, stale: the key's count as it stood when the packet's interval began."""

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before, total = state.get if state.exists else (-(1 << 62), 0, 0)
        rows = in_order(batches)
        at = (rows["ts"].astype("datetime64[us]").astype(np.int64) // (1_000_000 * seconds)).to_numpy()
        count = total + np.arange(len(rows))  # before each row
        new = np.concatenate([[at[0] != last], at[1:] != at[:-1]])
        seen = np.maximum.accumulate(np.where(new, count, before))
        state.update((int(at[-1]), int(seen[-1]), int(total + len(rows))))
        yield pd.DataFrame({"pkt_id": rows["pkt_id"], "stale": seen})

    return stream.groupBy(key).applyInPandasWithState(step, "pkt_id long, stale long", "last long, before long, total long", "append", GroupStateTimeout.NoTimeout)


def idle_sessions(stream: DataFrame, *keys, idle: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of packets of a key without a pause of idle; a session is given out when the watermark has passed its end."""
    w = F.session_window("ts", idle)
    return stream.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.min("ts").alias("started")).drop("w")


def run_to(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """What there is now, as Parquet files; each row exactly once, also after a restart from the checkpoint. Returns the progress of the micro-batches."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


def run_changes(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """What there is now, through a stream whose rows change: each micro-batch's rows in a folder of their own, which a repetition writes over."""

    def put(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that run_changes() has written."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "epoch").alias("last")).select(*keys, "last.*")
