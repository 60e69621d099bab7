"""What the operators of this folder share: reading tables, cutting lineage, streaming rows in groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """The path of a folder that isn't there yet, in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_folder() named, when nothing will read it again."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. Where the session names none, a temporary one is set on a single machine, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weirflow-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; later steps and lost executors read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, least: int = 1) -> int:
    """Partitions that a shuffle of this session is dealt to."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(column: pa.Array) -> list[str]:
    """A column of texts as Python strings; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def ranges(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes together, at least one text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, most + (size[first - 1] if first else 0), "right")))
        yield first, last
        first = last


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Gives the system back what this process has freed. Workers go from task to task and from stage to stage, and would keep it."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one that turns a batch into a batch, of so many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                if (out := f(batch.slice(k, rows))) is not None and out.num_rows:
                    yield out
            out = None
            released()

    return run


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, from batches that are sorted by them. One group is in memory at a time, and one batch."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        columns = [np.asarray(t[k].to_numpy()) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
