"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

The number of bits grows with the number of vectors, so that a bucket holds about FILL of them
by chance, and the number of tables is what the target recall asks for at the threshold. All
bits of a vector together are its code. Identical vectors are one with a weight from the start,
and only vectors of the same length meet. In each table, codes are dealt by bucket; a bucket of
more than BLOCK is cut into blocks, and every pair of blocks is its own piece of work, so no
task holds more than two blocks. Two that meet there for the first time (in no earlier table,
as their codes tell) and whose codes differ in no more bits than a pair at the threshold does
but for MISSED of all cases are candidates. Only vectors with candidates are sent, to the
buckets where they have them, and cosines are computed in double precision there. What leaves a
piece of work is, for each vector, the weight of its links and one edge to the smallest vector
that it hangs together with, never the pairs.

Defined results: vectors that are null, all zero, or with null or non-finite components link
with nothing, nor do those of different lengths; rows of equal vectors are linked with each
other; rows of the same id count as one vector each and share a component; ids are of any type
that has an order, and null comes after all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, groups, parts, settle
from .components import components

THRESHOLD = 0.95
RECALL = 0.9995
FILL = 512
BLOCK = 1024
MISSED = 1e-6


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = max(4, min(48, math.ceil(math.log2(max(2, n / FILL)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def hyperplanes(size: int, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, bits * tables))


def units(lists: pa.ListArray) -> np.ndarray:
    """Vectors of length one, in double precision; first scaled, so that no square overflows or vanishes."""
    v = lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def hub_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the first row that it hangs together with."""
    own = np.arange(len(linked))
    while True:
        new = np.minimum(own, np.where(linked, own[None, :], len(own)).min(1))
        new = new[new]
        if (new == own).all():
            return own
        own = new


def most_apart(bits: int, tables: int, threshold: float) -> int:
    """In how many bits the codes of a pair at the threshold, equal in one table, differ at most, but for MISSED of all cases."""
    n, p = bits * (tables - 1), math.acos(threshold) / math.pi
    chance = total = (1 - p) ** n
    most = 0
    while total < 1 - MISSED and most < n:
        chance *= (n - most) / (most + 1) * p / (1 - p)
        total, most = total + chance, most + 1
    return most


def met_first(codes: np.ndarray, t: int, bits: int, most: int) -> np.ndarray:
    """Which pairs of rows of codes (words of 64 bits) are equal in table t, in no table before, and differ in most bits at most."""
    apart = np.zeros((len(codes), len(codes)), np.int32)
    for k in range(codes.shape[1]):
        apart += np.bitwise_count(codes[:, None, k] ^ codes[None, :, k])
    out = apart <= most
    np.fill_diagonal(out, False)
    a, b = np.nonzero(out)
    if len(a):
        own = np.unpackbits(codes.view(np.uint8), axis=1, count=(t + 1) * bits, bitorder="little").reshape(len(codes), t + 1, bits)
        weights = 1 << np.arange(bits, dtype=np.int64)
        keys = own @ weights
        bad = keys[a, t] != keys[b, t]
        for k in range(t):
            bad |= keys[a, k] == keys[b, k]
        out[a[bad], b[bad]] = False
    return out


@lru_cache(maxsize=64)
def planes_of(size: int, bits: int, tables: int) -> np.ndarray:
    return hyperplanes(size, bits, tables)


def near(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    raw_type, id_type = (vectors.schema[c].dataType.simpleString() for c in (vector_col, id_col))
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("raw"))

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0, lists.offsets.to_numpy()
        rows = [flat[a:b] if b > a and there else None for a, b, there in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
        same = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if v is not None and np.isfinite(v).all() and v.any() else None for v in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(same, pa.binary())], ["id", "raw", "same"])

    marked = settle(given.mapInArrow(by_batch(look), f"id {id_type}, raw {raw_type}, same binary"))
    sound = F.col("same").isNotNull()
    order = F.struct(F.col("id").isNull().alias("no"), "id")
    classes = marked.where(sound).groupBy("same").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("weight"), F.first("raw").alias("v"))
    # a class goes by a number of its own, since ids may be of any type, null or repeated
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    bits, tables = plan(n, threshold, recall)
    most, words = most_apart(bits, tables, threshold), -(-bits * tables // 64)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def keyed(batch: pa.RecordBatch):
        lists, out = batch.column(1), []
        length = np.diff(lists.offsets.to_numpy())
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            signs = units(lists.take(pa.array(own))) @ planes_of(size, bits, tables) > 0
            code = np.zeros((len(own), 8 * words), np.uint8)
            short = np.packbits(signs, axis=1, bitorder="little")
            code[:, : short.shape[1]] = short
            keys = signs.reshape(len(own), tables, bits) @ powers
            out.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(np.full(len(own), size, np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(own), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))], ["rep", "size", "code", "keys"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    met = classes.select("rep", "v").mapInArrow(by_batch(keyed), "rep long, size int, code binary, keys array<long>").select("rep", "size", "code", F.posexplode("keys").alias("t", "key"))
    bucket = ["size", "t", "key"]
    work = [*bucket, "x", "y"]
    # buckets of one vector are nothing to compare; those of more than one block are cut
    large = settle(met.groupBy(*bucket).count().where(F.col("count") > BLOCK).select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    placed = met.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a row goes to every pair of blocks that its own is in
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*bucket, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "code")
    dealt = sent.repartition(parts(spark), *work).sortWithinPartitions(*work)

    def pairs(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The codes' candidates, and the block of each row."""
        codes = np.frombuffer(b"".join(g["code"].to_pylist()), np.uint64).reshape(g.num_rows, words)
        out, own = met_first(codes, g["t"][0].as_py(), bits, most), g["own"].to_numpy()
        if g["x"][0].as_py() != g["y"][0].as_py():
            out &= own[:, None] != own[None, :]
        return out, own

    def candidates(batches):
        for g in groups(batches, work):
            if g.num_rows > 1:
                some = np.flatnonzero(pairs(g)[0].any(1))
                if len(some):
                    yield from g.take(pa.array(some)).combine_chunks().to_batches()

    kept = settle(dealt.mapInArrow(candidates, "size int, t int, key long, x int, y int, own int, rep long, code binary"))
    full = kept.join(classes.select("rep", "weight", "v"), "rep").select(*work, "own", "rep", "code", "weight", "v")
    dealt = full.repartition(parts(spark), *work).sortWithinPartitions(*work, "rep")

    def compare(batches):
        held: dict[str, list] = {"rep": [], "n": [], "hub": []}
        for g in groups(batches, work):
            g = g.combine_chunks()
            rep, weight = (g[c].to_numpy() for c in ("rep", "weight"))
            v = units(g["v"].chunk(0))
            linked = (v @ v.T >= threshold) & pairs(g)[0]
            some = np.flatnonzero(linked.any(1))
            if not len(some):
                continue
            held["rep"].append(rep[some])
            held["n"].append((linked @ weight)[some])
            held["hub"].append(rep[hub_of(linked)][some])
            if len(held["rep"]) >= 200:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(c) for k, c in held.items()})
                held = {k: [] for k in held}
        if held["rep"]:
            yield pa.RecordBatch.from_pydict({k: np.concatenate(c) for k, c in held.items()})

    found = settle(dealt.mapInArrow(compare, "rep long, n long, hub long").groupBy("rep", "hub").agg(F.sum("n").alias("n")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("hub").alias("b")).where("a != b"))
    whole = classes.select("same", "rep", "f", "weight").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    whole = settle(whole.select("same", "f", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    heads = settle(whole.groupBy("component").agg(F.min("f").alias("head")))
    state = settle(whole.join(heads, "component").select("same", "n_links", F.col("head.id").alias("component_id")))
    sound_rows = marked.where(sound).select("id", "same").join(state, "same").select("id", "n_links", "component_id")
    rest = marked.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return sound_rows.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
