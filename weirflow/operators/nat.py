"""Address translation: each new flow gets a port of the public address, in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import FLOW

PUBLIC_IP = 0x0A000001
FIRST_PORT, LAST_PORT = 1024, 65_535


def table(df: DataFrame) -> DataFrame:
    """One row for each TCP flow: new_port, null where ports have run out. The pool has as many ports as it has, so only that many flows are numbered."""
    new = df.where("proto = 6").groupBy(*FLOW).agg(F.min(F.struct("ts", "pkt_id")).alias("f")).select(*FLOW, F.col("f.ts").alias("first_ts"), F.col("f.pkt_id").alias("first_pkt"))
    pool = LAST_PORT - FIRST_PORT + 1
    first = new.orderBy("first_ts", "first_pkt").limit(pool).select(*FLOW, "first_ts", "first_pkt")
    nth = F.row_number().over(Window.orderBy("first_ts", "first_pkt")) - 1  # no more rows than the pool has ports
    given = first.select(*FLOW, (F.lit(FIRST_PORT) + nth).cast("int").alias("new_port"))
    return new.join(given, list(FLOW), "left").select(*FLOW, "new_port")


def entries(flows: DataFrame) -> DataFrame:
    """Forward and reverse entries of the table: key, new_ip, new_port, is_forward."""
    some = flows.where("new_port is not null")
    ahead = some.select(*FLOW, F.lit(PUBLIC_IP).cast("long").alias("new_ip"), "new_port", F.lit(True).alias("is_forward"))
    back = some.select(F.col("dst_ip").alias("src_ip"), F.lit(PUBLIC_IP).cast("long").alias("dst_ip"), F.col("dst_port").alias("src_port"), F.col("new_port").alias("dst_port"), F.col("src_ip").alias("new_ip"), F.col("src_port").alias("new_port"), F.lit(False).alias("is_forward"))
    return ahead.unionByName(back)


def replies(df: DataFrame, flows: DataFrame) -> DataFrame:
    """Answers from outside to the packets of flows that have a port: from their destination to the public address and that port."""
    some = df.where("proto = 6").join(flows.where("new_port is not null"), list(FLOW))
    return some.select("pkt_id", F.col("dst_ip").alias("src_ip"), F.lit(PUBLIC_IP).cast("long").alias("dst_ip"), F.col("dst_port").alias("src_port"), F.col("new_port").alias("dst_port"), "proto")


def rewritten(df: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """TCP packets with the headers that leave: forward packets get the public source, reverse ones the private destination. flows: the table of ports, that of df if none is given."""
    hit = df.where("proto = 6").join(entries(table(df) if flows is None else flows), list(FLOW), "left")
    ahead, back = F.coalesce(F.col("is_forward"), F.lit(False)), F.coalesce(~F.col("is_forward"), F.lit(False))

    def own(column: str, translated: str, side: Column) -> Column:
        return F.when(side, F.col(translated)).otherwise(F.col(column)).alias(column)

    return hit.select("pkt_id", own("src_ip", "new_ip", ahead), own("dst_ip", "new_ip", back), own("src_port", "new_port", ahead), own("dst_port", "new_port", back))
