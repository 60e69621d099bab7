"""Token ids in byte-aligned files: ids ranked by frequency, one to four bytes each, lengths in separate control bytes.

A control byte holds the lengths of four ids; the numbers of the bytes that follow are known
from a table of 256 rows, so a block is decoded by numpy alone. Frequent ids get small ranks
and take one byte.

The first pass makes every document's ids and counts them; the second deals the ids (never
texts) by ranges of the document id, then of a hash of the text and the row's place, so that
many rows of one id are split too. So the ranks are those of the whole corpus. Each range is
cut into blocks of at most BLOCK_IDS ids (longer documents make longer blocks), and the blocks
are the rows of the files, with the ids of documents and their lengths. Files are written by
Spark, so they live in any store and a lost task is run again. The ranks are a table beside the
blocks.

Defined results: null and empty texts are the end id alone; repeated document ids keep all
their rows, ordered by a hash of the text; null ids come first; an empty table gives files
without blocks; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, new_folder, parts, ranges
from .tokens import AT_A_TIME, encoder

BLOCK_IDS = 1 << 18

#: Bytes that each of the four ids under a control byte takes.
LENGTHS = np.stack([1 + ((np.arange(256) >> s) & 3) for s in (0, 2, 4, 6)], 1).astype(np.int64)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, h (a hash of the text), row (a number of the row's own), n_ids and ids of each document; and for each task a row that counts its ids (n_ids -1)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        known, counts, row = encoder(vocabulary), np.zeros(0, np.int64), TaskContext.get().partitionId() << 40
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for first, last in ranges(batch.column(1), AT_A_TIME):
                some = batch.slice(first, last - first)
                ids, ends = known.encode_all(some.column(1))
                ids = np.insert(ids, ends, np.uint32(end_id))
                ends = ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                counts = added(counts, np.bincount(ids))
                width = 2 if int(ids.max()) < 1 << 16 else 4
                offsets = pa.array(np.append(0, ends) * width, pa.int64())
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(row + np.arange(len(n))), pa.array(n), blobs.cast(pa.binary())], [id_col, "h", "row", "n_ids", "ids"])
                row += len(n)
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([0], pa.int64()), pa.array([row], pa.int64()), pa.array([-1], pa.int64()), pa.array([packed(counts)], pa.binary())], [id_col, "h", "row", "n_ids", "ids"])

    given = docs.select(id_col, text_col, F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h"))
    return given.mapInArrow(run, f"`{id_col}` {id_type}, h long, row long, n_ids long, ids binary")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a = a.astype(np.int64)
    a[: len(b)] += b
    return a


def frequencies(rows: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in the corpus."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total = added(total, np.frombuffer(zlib.decompress(blob), np.int64))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    each = rows.where("n_ids = -1").select("ids").mapInArrow(run, "id long, n long")
    return each.groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes path/ranks (id, rank) and path/blocks. The ranks are as many as the vocabulary has ids, so they may go through the driver."""
    spark, held_at = docs.sparkSession, new_folder(docs.sparkSession, "token-ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = tokenize(docs, vocabulary, end_id)
    made.write.option("compression", "zstd").parquet(held_at)
    rows = spark.read.schema(made.schema).parquet(held_at)
    found = sorted(frequencies(rows).collect(), key=lambda r: (-r["n"], r["id"]))
    spark.createDataFrame([(r["id"], k) for k, r in enumerate(found)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max([r["id"] for r in found], default=0) + 1, "<u4")
    rank[[r["id"] for r in found]] = np.arange(len(found), dtype="<u4")
    shared = spark.sparkContext.broadcast(rank)

    def run(batches):
        from pyspark import TaskContext

        part, block, size = TaskContext.get().partitionId(), 0, 0
        names, lengths, held = [], [], []
        kind = pa.null()

        def out():
            control, data = encode_block(shared.value[np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(held, lengths, strict=True)])])
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "doc_ids", "lengths", "n_ids", "control", "data"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and size + n > BLOCK_IDS:
                    yield out()
                    block, size, names, lengths, held = block + 1, 0, [], [], []
                names.append(name)
                lengths.append(n)
                held.append(ids)
                size += n
        if held:
            yield out()

    order = ["doc_id", "h", "row"]
    dealt = rows.where("n_ids >= 0").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("doc_id", "n_ids", "ids")
    coded = dealt.mapInArrow(run, f"part int, block long, doc_ids array<{kind}>, lengths array<long>, n_ids long, control binary, data binary")
    coded.write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(spark, held_at)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, decoded from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = sorted(spark.read.parquet(f"{path}/ranks").collect(), key=lambda r: r["rank"])
    shared = spark.sparkContext.broadcast(np.asarray([r["id"] for r in ranks], "<u4"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, block, names, lengths, n, control, data = (batch.column(i)[k] for i in range(7))
                ids = shared.value[decode_block(control.as_py(), data.as_py(), n.as_py())].astype("<u4")
                size = np.asarray(lengths.as_py(), np.int64)
                ends = np.cumsum(size)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                m = len(size)
                yield pa.RecordBatch.from_arrays([names.values, pa.array([part.as_py()] * m, pa.int32()), pa.array([block.as_py()] * m, pa.int64()), pa.array(ends - size), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "part", "block", "within", "n_tokens", "ids_crc32"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = blocks.select("part", "block", "doc_ids", "lengths", "n_ids", "control", "data").mapInArrow(run, f"doc_id {kind}, part int, block long, within long, n_tokens long, ids_crc32 long")
    # Offsets in two steps: blocks within a range, then ranges, of which there are as many as partitions.
    own = blocks.select("part", "block", "n_ids")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    ranges = own.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    ranges = ranges.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("range_start"))
    offsets = own.select("part", "block", before.alias("block_start")).join(ranges, "part")
    return rows.join(offsets, ["part", "block"]).select("doc_id", (F.col("range_start") + F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the files and reads them back. path: a new folder, in the shared folder if none is named."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(spark, path)
