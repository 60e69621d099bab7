"""Packing documents into fixed-length sequences by best-fit decreasing.

Each document is cut into full windows first; a full window is a sequence of its own. What
remains of each document is placed, longest first, into the open sequence whose free room it
fits most tightly; a tree over the possible amounts of free room finds that sequence in the
logarithm of the window. The remains are dealt by a hash of the whole row and its place (many
rows of one id are split too) into groups of about ROWS_PER_GROUP, and each group is packed on
its own, so no task holds more than one group and only lengths move, never ids or texts.

Defined results: a null or empty text is the end id alone; equal documents are packed like
others; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ranges, released, settle
from .tokens import AT_A_TIME, encoder

WINDOW = 2048
ROWS_PER_GROUP = 32_768


class RoomTree:
    """A segment tree indexed by free room, 1 to a power of two: each node says whether any open sequence has room in its range."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence with the least room of at least need, taken out, and its room."""
        count, k = self.count, need + self.leaves
        while not count[k]:
            while k & 1:  # a right child: go up
                k >>= 1
            if not k:
                return None
            k += 1  # the right neighbour covers the next larger rooms
        while k < self.leaves:
            k *= 2
            k += not count[k]
        room = k - self.leaves
        sequence = self.open[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return sequence, room


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece, and the number of sequences. Pieces are no longer than the window."""
    tree, sequences = RoomTree(window), 0
    at, offset = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[k]
        if (found := tree.take(need)) is None:
            found, sequences = (sequences, window), sequences + 1
        sequence, room = found
        at[k], offset[k] = sequence, window - room
        if room > need:
            tree.add(room - need, sequence)
    return at, offset, sequences


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens. All pieces of a document but its last are full windows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        known = encoder(vocabulary)
        for batch in batches:
            for first, last in ranges(batch.column(1), AT_A_TIME):
                some = batch.slice(first, last - first)
                ids, ends = known.encode_all(some.column(1))
                ids = np.insert(ids, ends, np.uint32(end_id))
                ends = ends + np.arange(1, len(ends) + 1)
                total = np.diff(ends, prepend=0)
                n = -(-total // window)
                of = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, total[of] - start)
                at, raw = 4 * (ends[of] - total[of] + start), memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[of])], [id_col, "start", "length", "ids_crc32", "doc_tokens"])
                del some, ids, raw, of, start, length, at, crc
            released()

    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, window: int = WINDOW, rows_per_group: int = ROWS_PER_GROUP, id_col: str = "doc_id") -> DataFrame:
    """The rows of pieces() with sequence_id and offset. Sequence ids are unique, not gapless: a group's number, then the number within the group."""
    cut = settle(cut)
    groups = max(1, -(-cut.where(F.col("length") < window).count() // rows_per_group))
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("group_id", id_col, "start", "ids_crc32")])
        group = t["group_id"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = t.slice(a, b - a).drop_columns("group_id").combine_chunks()
            at, offset, _ = best_fit(own["length"].to_pylist(), window)
            own = own.append_column("sequence_id", pa.array(np.asarray(at, np.int64) * 2 + (np.int64(group[a]) << 32))).append_column("offset", pa.array(offset, pa.int64()))
            yield from own.to_batches()

    rest = cut.where(F.col("length") < window).withColumn("group_id", F.pmod(F.xxhash64(*cut.columns, F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    packed = rest.repartition(groups, "group_id").mapInArrow(place, schema)
    full = cut.where(F.col("length") == window)
    # a full window needs no company: its sequence is numbered by its own row, on odd numbers
    return packed.unionByName(full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Documents to packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, end_id, window), window, rows_per_group)
