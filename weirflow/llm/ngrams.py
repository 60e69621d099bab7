"""N-gram Jaccard join: MinHash banding, then full n-gram sets.

A document's set is that of its runs of five words. Documents with equal sets are one class
with a weight from the start. The number of bands follows from the rows of a band and the
target recall at the threshold: a pair of that similarity shares a band with probability
RECALL, a more similar one with more. Classes are shuffled on the hashes of their bands. A
bucket whose members are exactly those of a bucket of an earlier band says nothing new and is
left out. In each other bucket the full sets of its members, made from their texts, are
compared; a bucket of more than BLOCK members is cut into blocks, and every pair of blocks is
its own piece of work, so no task holds more than two blocks. What leaves a piece of work is,
for each member, the number of its links (each link counted in the first band in which the two
meet) and one edge to the first member that it hangs together with, never the pairs.

Defined results: null and empty texts, and texts without words, have no n-grams and link with
nothing; a text of fewer than five words is one n-gram; each row is a document, whatever its id:
repeated rows are linked with each other, and rows of one id and several texts, or without an id,
have the links of their own text; the smallest id is null only where all are; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, groups, parts, ranges, settle
from .components import components
from .embeddings import hub_of
from .shingles import SHINGLE, mixed, shingles_of, words_of

THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 5
BLOCK = 256
#: Different n-grams that are compared at a time, and bytes of texts that are hashed at a time.
COLUMNS, AT_A_TIME = 4096, 1 << 21


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of so many rows that a pair at the threshold shares one with the probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def multipliers(n: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray, bands: int, rows: int, by: np.ndarray) -> np.ndarray:
    """The hash of each band of the set's MinHash signature."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        some = shingles[k : k + 512, None] * by[None]
        np.minimum(least, (some ^ (some >> np.uint64(32))).min(0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(31) + least.reshape(bands, rows)[:, k])
    return out


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least threshold."""
    sizes = np.asarray([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    some = shared[inverse]
    column, owner = number[inverse[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    total = int(shared.sum())
    for first in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, total - first)), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def sets_of(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The n-gram sets of texts."""
    return [s for a, b in ranges(texts, AT_A_TIME) for s in shingles_of(words_of(texts.slice(a, b - a)), shingle)]


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text; null counts as the empty text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, class_id (the smallest id that links lead to), n_links (other documents at least as similar as threshold) and set_id (the smallest id with the same n-grams), one row for each row of docs."""
    return linked(docs, threshold, recall, shingle, id_col, text_col).select(id_col, "class_id", "n_links", "set_id")


def linked(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ngram_join, row (the row's row_key), and the first row of its class, by id and row: first_row with the id class_id. first_row is null for rows without n-grams."""
    spark = docs.sparkSession
    bands = bands_for(threshold, recall)
    by = multipliers(bands * ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("row"))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, keys = [], []
        for s in sets_of(batch.column(1), shingle):
            same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(band_keys(s, bands, ROWS, by).view(np.int64) if len(s) else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same, pa.binary()), lists], ["id", "row", "same", "keys"])

    signed = settle(given.mapInArrow(by_batch(sign), f"id {kind}, row long, same binary, keys array<long>"))
    # a class goes by a number of its own, since ids may be null or stand for several classes; f is its first row
    order = F.struct(F.col("id").isNull().alias("no"), "id", "row")
    classes = signed.where("same is not null").groupBy("same").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()))
    met = classes.select("rep", F.posexplode("keys").alias("t", "key"))
    # buckets by their members: their number, smallest, and the sum of their hashes
    buckets = met.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")).where("n > 1")
    buckets = settle(buckets.groupBy("n", "hub", "members").agg(F.min(F.struct("t", "key")).alias("b")).select("b.t", "b.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    placed = met.join(buckets, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    work = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "t", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    work = settle(work)
    # the texts of the classes that have work
    needed = settle(work.select("rep").distinct())
    held_by = classes.join(needed, "rep", "left_semi").select("rep", "weight", "keys", F.col("f.id").alias("id0"), F.col("f.row").alias("row0"))
    # rows that are repeated have one text
    content = given.join(held_by, F.col("id").eqNullSafe(F.col("id0")) & (F.col("row") == F.col("row0"))).select("rep", "weight", "keys", "text").dropDuplicates(["rep"])
    full = work.join(content, "rep").select("t", "key", "x", "y", "own", "rep", "weight", "keys", "text")
    dealt = full.repartition(parts(spark), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y", "rep")

    def compare(batches):
        held: dict[str, list] = {"rep": [], "n": [], "hub": []}

        def out():
            return pa.RecordBatch.from_pydict({k: np.concatenate(c) for k, c in held.items()})

        for g in groups(batches, ["t", "key", "x", "y"]):
            if g.num_rows < 2:
                continue
            t, x, y = (g[c][0].as_py() for c in ("t", "x", "y"))
            rep, weight, own = (g[c].to_numpy() for c in ("rep", "weight", "own"))
            linked = links(sets_of(g["text"].combine_chunks(), shingle), threshold)
            if x != y:
                linked &= own[:, None] != own[None, :]
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            keys = np.asarray(g["keys"].to_pylist())
            before = np.zeros(len(a), bool)
            for k in range(t):
                before |= keys[a, k] == keys[b, k]
            n = np.bincount(a, np.where(before, 0, weight[b]), len(rep)).astype(np.int64)
            some = np.flatnonzero(linked.any(1))
            held["rep"].append(rep[some])
            held["n"].append(n[some])
            held["hub"].append(rep[hub_of(linked)][some])
            if len(held["rep"]) >= 200:
                yield out()
                held = {k: [] for k in held}
        if held["rep"]:
            yield out()

    found = settle(dealt.mapInArrow(compare, "rep long, n long, hub long").groupBy("rep", "hub").agg(F.sum("n").alias("n")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b")).where("a != b")).withColumnRenamed("node", "rep")
    whole = classes.select("same", "rep", "f", "weight").join(counts, "rep", "left").join(joined, "rep", "left").select("same", "f", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    whole = settle(whole)
    heads = settle(whole.groupBy("component").agg(F.min("f").alias("head")))
    state = settle(whole.join(heads, "component").select("same", "n_links", F.col("f.id").alias("set_id"), F.col("head.id").alias("class_id"), F.col("head.row").alias("first_row")))
    some = signed.where("same is not null").select("id", "row", "same").join(state, "same").select("id", "class_id", "n_links", "set_id", "row", "first_row")
    rest = signed.where("same is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("set_id"), "row", F.lit(None).cast("long").alias("first_row"))
    return some.unionByName(rest).withColumnRenamed("id", id_col)
