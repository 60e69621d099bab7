"""Line dedup: runs of words that stood before are cut, found by winnowing.

A text is a sequence of words, split at white space. A window is RUN words on end. Every window
that stands at an earlier place of the corpus too (by doc_id, then place) is cut in the later
place, so every repeated run of RUN words or more goes, wherever in a line it begins and ends,
and whatever stands around its other places. Repetitions within a document count like those
between documents. Each word that is deleted stays in an earlier place.

Of the runs of GRAM words in a window the one with the least hash is the window's mark. It
depends on the window's words alone, so windows that are equal have equal marks, and only windows
whose mark stands in two places need a look. Windows side by side with one mark in common are a
segment. Of equal segments all but the first are cut whole; first segments whose mark also
stands in other segments are taken apart into their windows, and each window whose first place is
another one is cut. First places are partial minima, pairs of places are never made, and the
joins are of written tables, so Spark can split hot keys. Words, marks, segments and windows are
told apart by 64-bit hashes.

Defined results: a null text stays null, an empty one empty; documents with the same id and text
are one document and get the same result; of the same id and other text, they are ordered by a
hash of the text, null ids before all, and ids that aren't whole numbers by their hash; texts of fewer than RUN words stay; an empty table gives
no rows; other columns stay. A line is a stretch of text up to a line break or the end of a
sentence; n_lines counts those with words, n_cut those that are cut whole.

With whole_lines, lines are only cut whole, so that each line stays somewhere: every run of whole
lines of RUN words or more that stood before, with the same line ends, goes. There, the shortest
runs of whole lines with RUN words, from each line on and up to each line, are the segments. The
queries and the pipeline set it to False.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from .common import by_batch, dropped, new_folder, parts, ranges, released, settle
from .shingles import BASE, INVERSE, Bounds, bounds_of, mixed, powers, words_of

RUN = 30
#: Words whose hash can be a window's mark.
GRAM = 10
#: Bytes that are hashed at a time.
AT_A_TIME = 1 << 21
#: Bits of a filter, at most: with more keys it spares less.
BITS = 1 << 27
#: Bits of it that one task puts together.
PART = 1 << 20

class Runs:
    """The words of some texts, with the hash of any run of them. With whole_lines, a word's hash also tells whether it begins or ends a line."""

    def __init__(self, rows: pa.Array, whole_lines: bool = False):
        words = words_of(rows)
        self.counts, h = words.counts, words.hashes
        self.starts = np.cumsum(self.counts) - self.counts
        self.n = len(h)
        self.ends = np.flatnonzero(words.line_ends) + 1 if whole_lines else None
        if whole_lines and self.n:
            h = h.copy()
            h[np.concatenate([[0], self.ends[:-1]])] ^= BASE
            h[self.ends - 1] ^= INVERSE
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, self.n), dtype=np.uint64)])
        self.back = powers(INVERSE, self.n + 1)

    def runs(self, size: int) -> np.ndarray:
        """The hash of the run of size words from each place."""
        return mixed((self.sums[size:] - self.sums[: self.n + 1 - size]) * self.back[: self.n + 1 - size])

    def segments(self, run: int, gram: int) -> tuple[np.ndarray, ...]:
        """For each segment: its text, first window, number of windows, mark and hash."""
        if self.n < run:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        if self.ends is not None:
            begins = np.concatenate([[0], self.ends[:-1]])
            on, back = np.searchsorted(self.ends, begins + run), np.searchsorted(begins, self.ends - run, "right") - 1
            some = np.concatenate([np.stack([begins[on < len(on)], self.ends[on[on < len(on)]]], 1), np.stack([begins[back[back >= 0]], self.ends[back >= 0]], 1)])
            at, stop = np.unique(some[owner[some[:, 0]] == owner[some[:, 1] - 1]], axis=0).T
            whole = mixed((self.sums[stop] - self.sums[at]) * self.back[at])
            return owner[at], at - self.starts[owner[at]], stop - at - (run - 1), whole, whole
        marks = self.runs(gram)

        def least(a, b):
            return np.where(marks[b] < marks[a], b, a)  # the first of equal ones

        best, size, width = np.arange(len(marks)), 1, run - gram + 1
        while 2 * size <= width:
            best, size = least(best[:-size], best[size:]), 2 * size
        if size < width:
            best = least(best[: size - width], best[width - size :])
        windows = np.flatnonzero(owner[: self.n - run + 1] == owner[run - 1 :])
        if not len(windows):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        of = best[windows]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        n = np.diff(np.append(first, len(windows)))
        at = windows[first]
        whole = (self.sums[at + n + run - 1] - self.sums[at]) * self.back[at]
        return owner[at], at - self.starts[owner[at]], n, marks[of[first]], mixed(whole + n.astype(np.uint64) * BASE)


def joined(of: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of words, given in any order with the number of their document, as the ranges that they cover, in order."""
    if not len(of):
        return of, at, stop
    order = np.lexsort((at, of))
    of, at, stop = of[order], at[order], stop[order]
    far = np.maximum.accumulate((of << 32) + stop)
    first = np.flatnonzero(np.concatenate([[True], (of[1:] << 32) + at[1:] > far[:-1]]))
    return of[first], at[first], far[np.append(first[1:], len(of)) - 1] & 0xFFFFFFFF


def cut_texts(texts: pa.Array, of: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """Texts without the words in ranges, as joined() has them, with the text's number; the lines of each text, those that are cut whole, and the spans cut out. What stands before the first word goes with it."""
    words = bounds_of(texts)
    counts, starts = words.counts, np.cumsum(words.counts) - words.counts
    ends = np.concatenate([[0], np.flatnonzero(words.line_ends) + 1])
    lines, said, n_cut = line_counts(words), [""] * len(texts), np.zeros(len(texts), np.int64)
    if not len(of):
        return texts, lines, n_cut, said
    begin, end = starts[of] + at, starts[of] + stop
    np.add.at(n_cut, of, np.maximum(0, np.searchsorted(ends, end, "right") - 1 - np.searchsorted(ends, begin)))
    points, length = words.points()
    points = np.append(points, 0)
    left = np.where(at == 0, 0, points[begin]).tolist()
    right = np.where(stop == counts[of], length[of], points[end]).tolist()
    out, edges = texts.to_pylist(), np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])).tolist()
    for first, last, k in zip(edges[:-1], edges[1:], of[edges[:-1]].tolist(), strict=True):
        text, kept, done = out[k], [], 0
        for a, b in zip(left[first:last], right[first:last], strict=True):
            kept.append(text[done:a])
            done = b
        out[k] = "".join([*kept, text[done:]])
        said[k] = ",".join(f"{a}:{b}" for a, b in zip(left[first:last], right[first:last], strict=True))
    return pa.array(out, texts.type), lines, n_cut, said


class Tables:
    """Tables that are computed once and kept in the shared folder as Parquet, which takes less room there than settle's rows, until they are dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "lines")
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes those that there are."""
        for path in self.paths:
            dropped(self.spark, path)
        self.paths = []


def bits_of(columns: list[pa.Array], size: int) -> np.ndarray:
    """The place of each row's key (one or two columns of numbers) in a filter of size bits, a power of two."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mixed(h * BASE + c.to_numpy().view(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64)


def filter_of(keys: DataFrame) -> np.ndarray:
    """Bits that tell which keys (rows of one or two columns of numbers) may be there: most that aren't are spared, none that is gets lost.

    The bits are put together in parts of PART, so that no task and no message has more than all BITS.
    """
    size = min(BITS, max(1 << 10, 1 << (8 * keys.count()).bit_length()))

    def at(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(bits_of(batch.columns, size)).astype(np.int32))], ["bit"])

    def pack(t: pa.Table) -> pa.Table:
        part, own = t["part"][0].as_py(), np.zeros(min(PART, size), bool)
        own[t["bit"].to_numpy() - part * PART] = True
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    bits = keys.mapInArrow(by_batch(at), "bit int").distinct().withColumn("part", F.floor(F.col("bit") / PART).cast("int"))
    out = np.zeros(size // 8, np.uint8)
    for r in bits.groupBy("part").applyInArrow(pack, "part int, bits binary").collect():
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * PART // 8 : r["part"] * PART // 8 + len(own)] = own
    return out


def maybe(bits: np.ndarray, key: tuple[int, ...], f=None, there: bool = True):
    """A function for mapInArrow that leaves the rows whose key, the columns of these numbers, may be in a filter, or those where it isn't, and applies f to them."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(bits)

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = bits_of([batch.column(c) for c in key], 8 * len(shared.value))
        found = (shared.value[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)
        some = batch.filter(pa.array(found if there else ~found))
        return f(some) if f else some

    return by_batch(own)


def line_counts(words: Bounds) -> np.ndarray:
    """The number of lines with words of each text."""
    total, ends = np.concatenate([[0], np.cumsum(words.line_ends)]), np.cumsum(words.counts)
    return total[ends] - total[ends - words.counts]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, gram: int = GRAM, whole_lines: bool = True) -> DataFrame:
    """docs with repeated runs cut from the text, and columns n_lines, n_cut (lines cut whole) and cut (spans start:end, in code points of the text as it was)."""
    spark = docs.sparkSession
    number = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    key = [F.coalesce(number, F.lit(-(2**63))).alias("d"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h")]
    place = F.struct("d", "h", "at")

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b in ranges(batch.column(2), AT_A_TIME):
            of, at, n, mark, seg = Runs(batch.column(2).slice(a, b - a), whole_lines).segments(run, gram)
            take = pa.array(of + a)
            out.append(pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(seg.view(np.int64))], ["d", "h", "at", "n", "mark", "seg"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else None

    keyed = docs.where(F.col(text_col).isNotNull()).select(*key, F.col(text_col).alias("text"))
    early, tables = Tables(spark), Tables(spark)
    seen = early.written(keyed.mapInArrow(by_batch(look), "d long, h long, at int, n int, mark long, seg long"))
    marks = settle(seen.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mark"))
    again = tables.written(seen.join(marks, "mark").select("d", "h", "at", "n", "mark", "seg"))
    early.drop()
    first = tables.written(again.groupBy("seg").agg(F.min(F.struct("d", "h", "at", "n", "mark")).alias("f")).select("seg", "f.*"))
    later = again.join(first.select("seg", F.struct("d", "h", "at").alias("f")), "seg").where(place > F.col("f"))
    several = settle(first.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mark"))
    apart = settle(first.join(several, "mark").groupBy(F.col("d").alias("d0"), F.col("h").alias("h0")).agg(F.collect_list(F.struct("at", "n")).alias("segs")))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        segs, out = batch.column(3), []
        for a, b in ranges(batch.column(2), AT_A_TIME):
            words = Runs(batch.column(2).slice(a, b - a), whole_lines)
            own = segs.slice(a, b - a)
            of = np.repeat(np.arange(b - a), pc.list_value_length(own).to_numpy())
            at, n = (own.flatten().field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of, at = np.repeat(of, n), np.repeat(at, n) + within
            take = pa.array(of + a)
            out.append(pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(words.runs(run)[words.starts[of] + at].view(np.int64))], ["d", "h", "at", "win"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    few = keyed.mapInArrow(maybe(filter_of(apart.select("d0", "h0")), (0, 1)), keyed.schema)
    needed = few.join(apart, (F.col("d") == F.col("d0")) & (F.col("h") == F.col("h0"))).select("d", "h", "text", "segs")
    parted = tables.written(needed.mapInArrow(by_batch(windows), "d long, h long, at int, win long"))
    least = settle(parted.groupBy("win").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f < l").select("win", "f"))
    others = parted.join(least, "win").where(place > F.col("f"))
    cuts = later.select("d", "h", "at", (F.col("at") + F.col("n") + (run - 1)).alias("stop")).unionByName(others.select("d", "h", "at", (F.col("at") + run).alias("stop")))
    cuts = settle(cuts.groupBy(F.col("d").alias("d0"), F.col("h").alias("h0")).agg(F.collect_set(F.struct("at", "stop")).alias("c")))
    tables.drop()
    # docs' columns by number, so that no name clashes
    names = [f"c{k}" for k in range(len(docs.columns))]
    whole, at_text = docs.select(*key, *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))), 2 + docs.columns.index(text_col)
    out_names = [*docs.columns, "n_lines", "n_cut", "cut"]
    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema.fields), StructField("n_lines", LongType()), StructField("n_cut", LongType()), StructField("cut", StringType())])
    bits = filter_of(cuts.select("d0", "h0"))

    def as_it_is(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents of which nothing is cut."""
        n, text = len(batch), batch.column(at_text)
        lines = [line_counts(bounds_of(text.slice(a, b - a))) for a, b in ranges(text, AT_A_TIME)]
        return pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(np.concatenate([np.zeros(0, np.int64), *lines])), pa.array(np.zeros(n, np.int64)), pa.array([""] * n, pa.string())], out_names)

    # most documents aren't cut and stay where they are; those that may be are dealt with their cuts
    kept = whole.mapInArrow(maybe(bits, (0, 1), as_it_is, False), schema)
    told = cuts.select(F.col("d0").alias("d"), F.col("h0").alias("h"), F.lit(0).alias("kind"), F.col("c.at").alias("at"), F.col("c.stop").alias("stop"))
    some = whole.mapInArrow(maybe(bits, (0, 1)), whole.schema).withColumn("kind", F.lit(1))
    dealt = some.unionByName(told, allowMissingColumns=True).repartition(parts(spark), "d", "h").sortWithinPartitions("d", "h", "kind").select("d", "h", *names, "kind", "at", "stop")

    def cut(batches):
        last, gone = None, (np.zeros(0, np.int64),) * 2  # the last row's key, and what is cut of it
        for batch in batches:
            if not batch.num_rows:
                continue
            d, h, kind = (batch.column(k).to_numpy() for k in (0, 1, 2 + len(names)))
            new = np.concatenate([[(d[0], h[0]) != last], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
            key = np.cumsum(new)  # 0: that of the batch before
            some = batch.filter(pa.array(kind == 0)).columns[3 + len(names) :]
            of = np.repeat(key[kind == 0], pc.list_value_length(some[0]).to_numpy())
            of, at, stop = joined(np.concatenate([np.zeros(len(gone[0]), np.int64), of]), *(np.concatenate([g, c.flatten().to_numpy().astype(np.int64)]) for g, c in zip(gone, some, strict=True)))
            begins = np.searchsorted(of, key)
            times = np.searchsorted(of, key, "right") - begins
            last, gone = (d[-1], h[-1]), tuple(c[of == key[-1]] for c in (at, stop))
            rows = np.flatnonzero(kind == 1)
            docs_there = batch.take(pa.array(rows))
            for a, b in ranges(docs_there.column(at_text), AT_A_TIME):
                n = times[rows[a:b]]
                own = np.repeat(begins[rows[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                part = docs_there.slice(a, b - a)
                text, *found = cut_texts(part.column(at_text), np.repeat(np.arange(b - a), n), at[own], stop[own])
                columns = part.columns[2 : 2 + len(names)]
                columns[at_text - 2] = text
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.string()), strict=True))], out_names)
            released()

    return kept.unionByName(dealt.mapInArrow(cut, schema))
