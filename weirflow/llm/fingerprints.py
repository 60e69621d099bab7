"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line of the text) is hashed to a wide vector: EQUAL lanes of 64 bits that
depend on the whole paragraph, and LIKE lanes of 32 bits in which every run of SHINGLE words
(all words, if there are fewer) adds or subtracts one. A document's fingerprint is the sum of
its paragraphs' vectors, each lane modulo its power of two. So it doesn't depend on the order
of paragraphs, and adding or deleting a paragraph adds or subtracts its vector. The EQUAL lanes
tell equal multisets apart from all others; the cosine of the LIKE lanes estimates how much
text two documents share.

Defined results: null and empty texts have no paragraph, their fingerprint is zero; the
likeness of two zero fingerprints is 1, of a zero and another 0; of LIKE lanes that are all
zero by chance, 1 if the fingerprints are equal and else 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, ranges
from .shingles import SHINGLE, words_of

EQUAL, LIKE = 8, 256
#: Bytes of texts that are fingerprinted at a time.
AT_A_TIME = 1 << 20


class Fingerprint:
    """equal: EQUAL lanes modulo 2**64; like: LIKE lanes modulo 2**32."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None) -> None:
        self.equal = np.zeros(EQUAL, np.uint64) if equal is None else equal
        self.like = np.zeros(LIKE, np.int32) if like is None else like

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.like - other.like)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.equal == other.equal).all() and (self.like == other.like).all())

    __hash__ = None

    def __str__(self) -> str:
        return base64.b64encode(self.equal.astype("<u8").tobytes() + self.like.astype("<i4").tobytes()).decode()

    @classmethod
    def parse(cls, said: str) -> Fingerprint:
        raw = base64.b64decode(said)
        return cls(np.frombuffer(raw[: 8 * EQUAL], "<u8").astype(np.uint64), np.frombuffer(raw[8 * EQUAL :], "<i4").astype(np.int32))

    def likeness(self, other: Fingerprint) -> float:
        return float(likenesses(self.equal[None], self.like[None], other.equal[None], other.like[None])[0])


def likenesses(equal: np.ndarray, like: np.ndarray, other_equal: np.ndarray, other_like: np.ndarray) -> np.ndarray:
    """How like the fingerprints of rows are, 0 to 1."""
    same = (equal == other_equal).all(1) & (like == other_like).all(1)
    a, b = like.astype(np.float64), other_like.astype(np.float64)
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.clip((a * b).sum(1) / np.where(norm == 0, 1, norm), 0, 1)
    return np.where(same, 1.0, np.where(norm == 0, 0.0, cosine))


def lanes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """EQUAL and LIKE lanes of several texts: the sums of the vectors of their paragraphs."""
    paragraphs = [text.split("\n") if text else [] for text in rows]
    flat = [p for own in paragraphs for p in own]
    of = np.repeat(np.arange(len(rows)), [len(own) for own in paragraphs])
    digest = hashlib.blake2b
    each = np.frombuffer(b"".join(digest(p.encode(), digest_size=8 * EQUAL).digest() for p in flat), "<u8").reshape(-1, EQUAL)
    equal, like = np.zeros((len(rows), EQUAL), np.uint64), np.zeros((len(rows), LIKE), np.int32)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    if len(first):
        equal[of[first]] = np.add.reduceat(each, first, dtype=np.uint64)
    words = words_of(pa.array(flat, pa.large_string()))
    h, size = words.hashes, words.counts
    n = len(h)
    if not n:
        return equal, like
    # a running hash of up to SHINGLE words, which stops at the paragraph's end
    ends = np.repeat(np.cumsum(size), size)
    at, run = np.arange(n), np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < ends, np.concatenate([h[k:], np.zeros(min(k, n), np.uint64)]), np.uint64(0))
    run ^= run >> np.uint64(31)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    whole = (at + SHINGLE <= ends) | (at == ends - np.repeat(size, size))
    run, owner = run[whole], np.repeat(of, size)[whole]
    lane = (run >> np.uint64(56)).astype(np.int64)
    sign = ((run >> np.uint64(55)) & np.uint64(1)).astype(np.float64) * 2 - 1
    like += np.bincount(owner * LIKE + lane, sign, like.size).astype(np.int64).astype(np.int32).reshape(like.shape)
    return equal, like


def fingerprint(text: str) -> Fingerprint:
    """The sum of the vectors of the text's paragraphs."""
    equal, like = lanes([text])
    return Fingerprint(equal[0], like[0])


def borders(docs: DataFrame, buckets: int) -> tuple[list[float], dict[float, int]]:
    """Ids that cut docs into about buckets ranges of equal counts, and how many ranges each id that fills more than one has. They are quantiles, as many as there are ranges."""
    key = F.col("doc_id").cast("double")
    found = docs.select(key.alias("k")).approxQuantile("k", [k / buckets for k in range(1, buckets)], max(0.2 / buckets, 1e-4)) if buckets > 1 else []
    times = Counter(found)
    return sorted(times), {k: n for k, n in times.items() if n > 1}


def ranged(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text) with columns h, a hash of the text (53 bits, so that quantiles have them all), and bucket: ranges in the order of id (null last) and h, of about equal counts.

    An id that fills several ranges, as null may, has them by quantiles of h; and of one h that
    fills several, rows are dealt by turns, as they are the same.
    """
    from pyspark.ml.feature import Bucketizer

    keyed = docs.withColumn("h", F.shiftright(F.xxhash64("text"), 11)).withColumn("k", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf"))))
    cuts, hot = borders(docs, buckets)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("none")).first()
    hot[float("inf")] = max(1, -(-total["none"] * buckets // max(1, total["n"])))
    # bucket numbers: the ranges of each cut follow each other, then those of null
    first, at = [0], 1
    for cut in cuts:
        first.append(at)
        at += hot.get(cut, 1)
    first.append(at)
    index = F.lit(0)
    if cuts:
        index = F.col("i").cast("int")
        keyed = Bucketizer(splits=[float("-inf"), *cuts, 1.7e308], inputCol="b", outputCol="i").transform(keyed.withColumn("b", F.least("k", F.lit(1.6e308))))
    # the last range of a cut also has the ids behind it
    last = [0, *(a + hot.get(c, 1) - 1 for a, c in zip(first[1:-1], cuts, strict=True))]
    keyed = keyed.withColumn("bucket", F.when(F.col("k") == float("inf"), first[-1]).otherwise(F.element_at(F.array(*map(F.lit, last)), index + 1)))
    several = {k: n for k, n in hot.items() if n > 1}
    if several:
        most = 8 * max(several.values())
        marks = keyed.where(F.col("k").isin([*several])).groupBy("k").agg(F.percentile_approx("h", [j / most for j in range(1, most)], 100 * most).alias("q")).collect()
        rows = [(r["k"], [r["q"][round(j * most / several[r["k"]]) - 1] for j in range(1, several[r["k"]])], first[-1] if r["k"] == float("inf") else first[1 + cuts.index(r["k"])]) for r in marks]
        table = docs.sparkSession.createDataFrame(rows, "k double, cuts array<long>, from int")  # as many numbers as ranges
        keyed = keyed.join(F.broadcast(table), "k", "left")
        low, high = (F.size(F.filter("cuts", f)) for f in (lambda c: c < F.col("h"), lambda c: c <= F.col("h")))
        turn = F.pmod(F.monotonically_increasing_id(), high - low + 1).cast("int")
        keyed = keyed.withColumn("turn", turn).withColumn("bucket", F.when(F.col("cuts").isNull(), F.col("bucket")).otherwise(F.col("from") + low + F.col("turn")))
    return keyed.select("doc_id", "text", "h", "bucket")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, extra: rows dealt by ranges of doc_id and sorted by bucket, extra, doc_id and a hash of the text. The first row of each bucket is also, as extra, the last of the bucket before, and that of the first bucket the last of all. Text null: empty."""
    n = parts(docs.sparkSession)
    keyed = ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 3 * n)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    heads = sorted(keyed.groupBy("bucket").agg(F.min(order).alias("o")).collect(), key=lambda r: r["bucket"])  # a row for each bucket
    kind = docs.schema["doc_id"].dataType.simpleString()
    moved = docs.sparkSession.createDataFrame([(r["bucket"], r["o"]["doc_id"], r["o"]["h"], heads[k - 1]["bucket"]) for k, r in enumerate(heads)], f"bucket int, head {kind}, head_h long, to int")
    same = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h"))
    first = keyed.join(F.broadcast(moved), "bucket").where(same).groupBy(F.col("to").alias("bucket"), "doc_id", "h").agg(F.first("text").alias("text")).select("doc_id", "text", "h", "bucket", F.lit(1).alias("extra"))
    dealt = keyed.select("doc_id", "text", "h", "bucket", F.lit(0).alias("extra")).unionByName(first).repartition(n, "bucket")
    return dealt.sortWithinPartitions("bucket", "extra", F.asc_nulls_last("doc_id"), "h").select("doc_id", "text", "bucket", "extra")


def edited(text: str, following: str) -> str:
    """text with its last floor(n/4) code points replaced by the first as many (or all) of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like the edited and the next document's fingerprints are to it.

    Equal ids are ordered by a hash of their text, null ids come last. A single document is its own next.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the last row so far, which waits for its next: name, text, bucket, lanes
        for batch in batches:
            kinds = batch.schema.field(0).type
            for first, last in ranges(batch.column(1), AT_A_TIME):
                given, rows, bucket = (c.to_pylist() for c in batch.slice(first, last - first).columns[:3])
                equal, like = lanes(rows)
                if held:
                    given, rows, bucket = [held[0], *given], [held[1], *rows], [held[2], *bucket]
                    equal, like = np.concatenate([held[3], equal]), np.concatenate([held[4], like])
                held = given[-1], rows[-1], bucket[-1], equal[-1:], like[-1:]
                at = np.flatnonzero(np.asarray(bucket)[:-1] == np.asarray(bucket)[1:])
                changed = [edited(rows[k], rows[k + 1]) for k in at.tolist()]
                if not changed:
                    continue
                new_equal, new_like = lanes(changed)
                columns = [
                    pa.array([given[k] for k in at], kinds),
                    pa.array([len(rows[k]) for k in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([str(Fingerprint(equal[k], like[k])) for k in at]),
                    pa.array([str(Fingerprint(a, b)) for a, b in zip(new_equal, new_like, strict=True)]),
                    pa.array(likenesses(equal[at], like[at], new_equal, new_like)),
                    pa.array(likenesses(equal[at], like[at], equal[at + 1], like[at + 1])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return with_next(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


