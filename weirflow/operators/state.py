"""Keyed state: what the packets before a packet made of its key.

Arrival order is (ts, pkt_id). State that ends when its connection closes has generations:
the closing packet still belongs to the generation that it ends.

A key may have a third of all packets, so no task is to need all of a key's packets in order. They
are windows over key and slice of time; what the slices before have summed up to, from partial
sums, goes ahead of each slice's packets as one row. Packets are shuffled once, by key and slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flags import closes

ORDER = ("ts", "pkt_id")

#: Seconds of a slice: so few that one key's packets of a slice fit a task.
SLICE_SECONDS = 3600


@dataclass(frozen=True)
class StateMap:
    """A named state table: its key columns, whether one packet at a time may write it (single) and where its keys are placed."""

    name: str
    keys: tuple[str, ...]
    single: bool = True
    placement: str = "balanced"


_maps: dict[str, StateMap] = {}


def register(m: StateMap) -> StateMap:
    if m.placement not in ("local", "static", "hashing", "balanced"):
        raise ValueError(f"no placement {m.placement}")
    if _maps.setdefault(m.name, m) != m:
        raise ValueError(f"another map is named {m.name}")
    return m


def catalog(spark) -> DataFrame:
    """id, name, keys, kind and placement of the registered maps."""
    rows = [(k, m.name, ",".join(m.keys), "single" if m.single else "multi", m.placement) for k, m in enumerate(_maps.values())]
    return spark.createDataFrame(rows, "id int, name string, keys string, kind string, placement string")


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_names(df: DataFrame, *names: str) -> None:
    """Refuses names that df has: its columns are never overwritten unasked."""
    if free(df, *names) != list(names):
        raise ValueError(f"the input has one of the columns {names} already")


def time_slice(seconds: int) -> Column:
    """The number of the slice of time that a packet came in. Packets without a time order first; theirs are slices of 65536 packet numbers."""
    return F.coalesce(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds), F.lit(-(1 << 50)) + F.coalesce(F.floor(F.col("pkt_id") / 65536), F.lit(-1)))


def headed(df: DataFrame, heads: DataFrame, by: list[str], column: str) -> DataFrame:
    """df with a column of heads, which has a row for each value of by; null equals null."""
    names = free(df, *(f"{c}_of" for c in by), column)[:-1]
    right = heads.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), column)
    on = F.lit(True)
    for c, n in zip(by, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return df.join(right, on, "left").drop(*names)


def carried(df: DataFrame, keys: list[str], value: Column, seconds: int = SLICE_SECONDS, prior: str = "prior", last: str = "last") -> DataFrame:
    """df with prior (the sum of value over the key's earlier packets) and last (value of the packet just before, null for the key's first)."""
    new_names(df, prior, last)
    part, v, before, total, kind = free(df, "part", "v", "before", "total", "kind")
    given = df.withColumns({part: time_slice(seconds), v: value})
    per = given.groupBy(*keys, part).agg(F.sum(v).alias(total), F.max_by(v, F.struct(*ORDER)).alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = per.select(*keys, part, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(v), F.lag(before).over(Window.partitionBy(*keys).orderBy(part)).alias(before), F.lit(0).alias(kind))
    rows = given.withColumns({before: F.col(v), kind: F.lit(1)}).unionByName(heads, allowMissingColumns=True)
    own = Window.partitionBy(*keys, part).orderBy(kind, *ORDER)
    out = rows.withColumns({prior: F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, -1)), last: F.lag(before).over(own)})
    return out.where(F.col(kind) == 1).select(*df.columns, F.col(prior).cast("long").alias(prior), last)


def previous(df: DataFrame, keys: list[str], value: Column, name: str, seconds: int = SLICE_SECONDS) -> DataFrame:
    """df with a column of the value of the key's packet just before, null for its first."""
    new_names(df, name)
    part, v, before, nth = free(df, "part", "v", "before", "nth")
    given = df.withColumns({part: time_slice(seconds), v: value})
    per = given.groupBy(*keys, part).agg(F.max_by(v, F.struct(*ORDER)).alias(before))
    heads = per.select(*keys, part, F.lag(before).over(Window.partitionBy(*keys).orderBy(part)).alias(before))
    own = Window.partitionBy(*keys, part).orderBy(*ORDER)
    out = headed(given, heads, [*keys, part], before)
    out = out.withColumn(nth, F.row_number().over(own)).withColumn(name, F.when(F.col(nth) == 1, F.col(before)).otherwise(F.lag(v).over(own)))
    return out.select(*df.columns, name)


def summed(df: DataFrame, keys: list[str], order: list[str], part: Column, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the key's rows up to this one, in an order whose slices part numbers."""
    new_names(df, name)
    p, v, total = free(df, "part", "v", "total")
    given = df.withColumns({p: part, v: value})
    per = given.groupBy(*keys, p).agg(F.sum(v).alias(total))
    earlier = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    heads = per.select(*keys, p, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(total))
    out = headed(given, heads, [*keys, p], total)
    own = Window.partitionBy(*keys, p).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn(name, F.col(total) + F.sum(v).over(own)).select(*df.columns, name)


def with_generations(df: DataFrame, keys: list[str], ends: Column | None = None) -> DataFrame:
    """Columns version (how many times the key's state has ended before this packet) and created (whether the packet makes the state anew)."""
    new_names(df, "version", "created")
    prior, last = free(df, "prior", "last")
    out = carried(df, keys, (closes() if ends is None else ends).cast("long"), prior=prior, last=last)
    return out.select(*df.columns, F.col(prior).alias("version"), F.coalesce(F.col(last) == 1, F.lit(True)).alias("created"))


def running(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """A column with the sum of value over the key's packets, this one too: what a strict read after an update sees."""
    return summed(df, keys, list(ORDER), time_slice(SLICE_SECONDS), value, name)


def removed_after(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Columns version and count: state that is removed once it has counted n packets."""
    new_names(df, "version", "count")
    prior, last = free(df, "prior", "last")
    return carried(df, keys, F.lit(1), prior=prior, last=last).select(*df.columns, F.floor(F.col(prior) / n).alias("version"), (F.col(prior) % n + 1).alias("count"))


def gated(df: DataFrame, keys: list[str], amount: str, limit: int) -> DataFrame:
    """Columns prior and admitted: amounts count until their sum has reached limit."""
    new_names(df, "prior", "admitted")
    last = free(df, "last")[0]
    return carried(df, keys, F.col(amount), last=last).select(*df.columns, "prior", (F.col("prior") < limit).alias("admitted"))


def seen_before(df: DataFrame, keys: list[str]) -> DataFrame:
    """A column known, whether the key had a packet before: a list of keys that learns."""
    new_names(df, "known")
    prior, last = free(df, "prior", "last")
    return carried(df, keys, F.lit(1), prior=prior, last=last).select(*df.columns, (F.col(prior) > 0).alias("known"))


def limited(df: DataFrame, most: int, seconds: int = 1) -> DataFrame:
    """The first packets of each interval, at most so many: a rate limit. The rest are dropped by the limit itself."""
    at, nth = free(df, "at", "nth")
    timed = df.withColumn(at, time_slice(seconds))
    return timed.withColumn(nth, F.row_number().over(Window.partitionBy(at).orderBy(*ORDER))).where(F.col(nth) <= most).select(*df.columns)


def looked_up(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df with the state columns of a table, null where the key has no state: a read that makes nothing."""
    return df.join(table, keys, "left")


def stale(df: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """A column stale: the key's count as it stood when this packet's interval of so many seconds began, as a reader sees it who gets a new copy each interval.

    Counts leave each task by interval, and only those, not the packets, are summed in order.
    """
    new_names(df, "stale")
    at, n = free(df, "at", "n")
    timed = df.withColumn(at, time_slice(seconds))
    per = timed.groupBy(*keys, at).agg(F.count(F.lit(1)).alias(n))
    sums = per.select(*keys, at, (F.sum(n).over(Window.partitionBy(*keys).orderBy(at)) - F.col(n)).alias("stale"))
    return headed(timed, sums, [*keys, at], "stale").select(*df.columns, "stale")


def once(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """The first packet of each key that is hit: what has been found isn't looked for again."""
    found = free(df, "found")[0]
    return df.where(hit).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*ORDER)).alias(found)).select(*keys, f"{found}.*")
