"""Reassembly: when a segment that came out of order can be released.

Segment s of a flow is released when all segments before it have come, which is at the largest
arrival up to s; it was buffered if that is later than its own arrival.

A flow may have a third of all segments: maxima and sums go by slices of sequence numbers or
arrivals, and what the slices before come to is added from partial ones. So a task needs a slice of a flow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import free, headed, new_names, summed

BUFFER = 32
#: Sequence numbers, or arrivals, of a slice.
SLICE = 4096


def sliced(column: str) -> Column:
    return F.floor(F.col(column) / SLICE)


def with_payload(df: DataFrame, payload_len: str = "payload_len") -> DataFrame:
    """Segments that carry data: others pass without any state."""
    return df.where(F.col(payload_len) > 0)


def released(df: DataFrame, flow: list[str], seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """df with release and buffered. Repeated segments are released with the first."""
    new_names(df, "release", "buffered")
    part, most, before = free(df, "part", "most", "before")
    given = df.withColumn(part, sliced(seq))
    per = given.groupBy(*flow, part).agg(F.max(arrival).alias(most))
    earlier = Window.partitionBy(*flow).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = per.select(*flow, part, F.max(most).over(earlier).alias(before))
    out = headed(given, heads, [*flow, part], before)
    upto = Window.partitionBy(*flow, part).orderBy(seq).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("release", F.greatest(F.max(arrival).over(upto), before))
    return out.select(*df.columns, "release", (F.col("release") > F.col(arrival)).alias("buffered"))


def occupancy(df: DataFrame, flow: list[str], seq: str = "seq", arrival: str = "arrival") -> DataFrame:
    """For each flow: buffered segments, the most at one time, and whether that is over BUFFER. A segment is in the buffer from its arrival until just before its release."""
    some = released(df, flow, seq, arrival).where("buffered")
    steps = some.select(*flow, F.explode(F.array(F.struct(F.col(arrival).alias("at"), F.lit(1).alias("d")), F.struct(F.col("release").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*flow, "e.at", "e.d")
    held = summed(steps, flow, ["at", "d"], sliced("at"), F.col("d"), "held")
    return held.groupBy(*flow).agg(F.count(F.when(F.col("d") == 1, 1)).alias("n_buffered"), F.max("held").alias("peak"), (F.max("held") > BUFFER).alias("overflow"))
