"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of all words; sources whose share is over CEILING times what
they have stop there, and what is left over is shared among the others by weight again. A
source takes its documents whole as often as the target allows, then a part of them whose
sizes sum to the rest of the budget: documents are counted by exact size, an equal part of
each size is taken, and a bounded knapsack over the counts that are left fits what remains,
mostly to the word (see fit). Which documents of a size are taken is decided by a seeded hash.

Only counts by source and size are gathered, one task for each source; documents are ranked
within source, size and a slice of the hash, so that many documents of one size (copies) are
dealt over SLICES tasks. The words of each source, two numbers, are the only rows on the
driver; the shares are sent to the tasks if there are at most SENT sources, and else joined.

Defined results: a null text has size 0; a source without words has target 0 and its documents
are taken 0 words; null sources are one source, the last; documents of equal id and size are
interchangeable; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Words that the knapsack is to fit at first and at most, after division by the sizes' common divisor.
FIRST, LARGEST = 1 << 14, 1 << 24
#: Sources whose shares are sent to all tasks; more are joined by shuffling.
SENT = 100_000

WEIGHTS = (1.0, 2.0, 3.0)
CEILING = 3.0
SLICES = 256
SEED = 20_240

#: Words by which a run of other characters than these is a word: space, tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[float], ceiling: float = CEILING) -> list[float]:
    """The words that each source is to give. They sum to all words if the ceilings allow it."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), {k for k, n in enumerate(sizes) if n}
    while free:
        share = sum(weights[k] for k in free)
        over = {k for k in free if weights[k] / share * total > ceiling * sizes[k]}
        if not over:
            for k in free:
                out[k] = weights[k] / share * total
            break
        for k in over:
            out[k] = ceiling * sizes[k]
            total -= out[k]
        free -= over
    return out


def reachable(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take, so that the sum is the largest that can be made up to budget.

    Bit b of reach: the sum b can be made. Counts are split into powers of two; for each sum, the step
    that first made it is kept, and leads back. It takes 4 bytes for each sum up to budget.
    """
    take, reach, limit = [0] * len(sizes), 1, (1 << (budget + 1)) - 1
    by, steps = np.zeros(budget + 1, np.int32), []
    for k in sorted((k for k, s in enumerate(sizes) if 0 < s <= budget), key=lambda k: sizes[k]):
        n, power = min(counts[k], budget // sizes[k]), 1
        while n > 0 and not reach >> budget & 1:
            part = min(power, n)
            new = (reach << part * sizes[k]) & limit & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(raw)
                row, bit = np.nonzero(raw[some, None] >> np.arange(8, dtype=np.uint8) & 1)
                by[some[row] * 8 + bit] = len(steps)
                steps.append((k, part))
                reach |= new
            n, power = n - part, power * 2
    at = reach.bit_length() - 1
    while at:
        k, part = steps[by[at]]
        take[k] += part
        at -= part * sizes[k]
    return take


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their words come near to budget without passing it.

    An equal part of each size is taken, and a bounded knapsack fits the words that are left. If the
    budget isn't met to the word (what no sum of sizes can be by their common divisor doesn't
    count), a smaller part is fixed and the knapsack gets more, up to all or LARGEST words. So the
    result is the nearest there is if the budget is up to LARGEST times the common divisor, and
    else the nearest with a knapsack of so many; sizes over that are only taken in equal parts.
    """
    divisor = math.gcd(*sizes)
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if budget >= total or not divisor:
        return list(counts)
    whole, budget, total = [s // divisor for s in sizes], budget // divisor, total // divisor
    best, gap, window = [0] * len(sizes), budget + 1, FIRST
    while gap:
        fixed = max(0, budget - window)
        take = [n * fixed // total for n in counts]
        rest = budget - sum(s * t for s, t in zip(whole, take, strict=True))
        for k in sorted(range(len(whole)), key=lambda k: -whole[k]) if rest > window else ():  # down to what the knapsack is to fit
            if rest <= window:
                break
            more = min(counts[k] - take[k], -(-(rest - window) // whole[k]), rest // whole[k]) if whole[k] else 0
            take[k], rest = take[k] + more, rest - more * whole[k]
        fitted = reachable(whole, [n - t for n, t in zip(counts, take, strict=True)], min(rest, LARGEST))
        rest -= sum(s * t for s, t in zip(whole, fitted, strict=True))
        if rest < gap:
            best, gap = [a + b for a, b in zip(take, fitted, strict=True)], rest
        if window >= min(budget, LARGEST):
            break
        window = min(32 * window, LARGEST)
    return best


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING, seed: int = SEED, id_col: str = "doc_id", with_source: bool = False) -> DataFrame:
    """id_col, source (if asked for), size, source_size, target and taken (words the mix takes of the document: size times its copies) of each document.

    weights: of the sources in the order of their names' code points, null last, repeating.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = settle(docs.select(F.col(id_col), F.col("source"), size.alias("size")).withColumn("order", F.xxhash64(F.lit(seed), F.col(id_col), F.col("size"))))
    # the order's highest bits are its slice
    own = own.withColumn("slice", F.shiftright("order", 56).cast("int") + 128)
    histogram = settle(own.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")))
    words = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    words = settle(words.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))  # one row a source; texts are ordered by their bytes, so by code point
    known = words.select("k", "source_size").toArrow().sort_by("k")["source_size"].to_pylist()
    target = targets(known, [weights[k % len(weights)] for k in range(len(known))], ceiling)
    given = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(known)), "target": np.asarray(target, float), "copies": np.asarray([int(t // n) if n else 0 for n, t in zip(known, target, strict=True)], np.int64)}), "k int, target double, copies long")
    send = F.broadcast if len(known) <= SENT else lambda df: df
    shares = words.join(send(given), "k").drop("k")
    # a source's sizes, one row each: as many as there are different sizes
    by_size = histogram.groupBy("source", "size").agg(F.sum("n").alias("n"))
    budgets = by_size.join(send(shares), by_size["source"].eqNullSafe(shares["source"])).select(by_size["source"], "size", "n", (F.round("target").cast("long") - F.col("copies") * F.col("source_size")).alias("budget"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        rows["pick"] = np.asarray(fit(rows["size"].tolist(), rows["n"].tolist(), max(0, int(rows["budget"].iloc[0]))), np.int64)
        return rows[["source", "size", "pick"]]

    picks = budgets.groupBy("source").applyInPandas(plan, "source string, size long, pick long")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("n")
    sliced = histogram.withColumn("before", before)
    same = sliced["source"].eqNullSafe(picks["source"]) & (sliced["size"] == picks["size"])
    quota = sliced.join(picks, same).select(sliced["source"], sliced["size"], "slice", F.greatest(F.lit(0), F.least("n", F.col("pick") - F.col("before"))).alias("quota"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("order", id_col)))
    same = ranked["source"].eqNullSafe(quota["source"]) & (ranked["size"] == quota["size"]) & (ranked["slice"] == quota["slice"])
    chosen = ranked.join(quota, same).select(ranked[id_col], ranked["source"], ranked["size"], (F.col("rank") <= F.col("quota")).cast("long").alias("more"))
    same = chosen["source"].eqNullSafe(shares["source"])
    return chosen.join(send(shares), same).select(id_col, *([chosen["source"]] if with_source else []), "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("more"))).alias("taken"), (F.col("copies") + F.col("more")).alias("copies"))
