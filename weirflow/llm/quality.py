"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are looked up in a learned table of EMBED numbers, and FILTERS learned filters of WIDTH
bytes are moved over them by STRIDE bytes. The text is covered by chunks of CHUNK bytes, each
of which begins where the last filter window of the chunk before ends its step, so they overlap
by WIDTH - STRIDE bytes and every window of the whole text lies in a chunk. Beside the bytes a
window sees, for each byte, how far back the same three bytes stood before, as one of ECHO
learned classes, so that filters can learn repetition. A chunk's value for a filter is the
largest of its windows; the largest of the chunks' values, of all filters, go through one
logistic layer to a probability.

Training uses at most MOST_ROWS labelled rows, the first by the crc32 of their id, whose texts
sum to at most MOST_CHARS, repeated rows once; they, and nothing else, go through the driver. Scoring reads each
document as a whole, in batches of chunks, wherever it lies.

Defined results: a null or empty text is one chunk of zero bytes and gets the score that the
network gives it; equal texts get equal scores; rows without labels are scored like others;
without any labelled rows of both labels, or an empty table, every score is the share of
label 1, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts

EMBED, FILTERS, WIDTH, STRIDE = 8, 16, 8, 2
WINDOWS = 128  # windows of a chunk
CHUNK = WIDTH + (WINDOWS - 1) * STRIDE
ECHO = 8
MOST_ROWS = 2000
MOST_CHARS = 8_000_000
EPOCHS, BATCH, RATE = 5, 32, 0.01
#: Steps of training at least: a small table is gone over more often.
STEPS = 400
#: Chunks that are in memory at a time.
AT_ONCE = 256


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text, at least WIDTH and a whole number of steps, and the class of the distance to the same three bytes before."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(WIDTH, WIDTH + -(-(len(raw) - WIDTH) // STRIDE) * STRIDE)
    b = np.zeros(n, np.uint8)
    b[: len(raw)] = raw
    echo = np.zeros(n, np.uint8)
    if len(raw) > 3:
        w = raw.astype(np.uint32)
        three = (w[:-2] << 16) | (w[1:-1] << 8) | w[2:]
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        gap = np.full(len(three), 1 << 30)
        gap[order[1:][same]] = (order[1:] - order[:-1])[same]
        echo[2 : 2 + len(three)] = ECHO - 1 - np.searchsorted([8, 16, 32, 64, 128, 256, 512], gap)
    return b, echo


class Network:
    """The network's numbers and what it says of texts."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "byte": r.normal(0, 0.3, (256, EMBED)).astype(np.float32),
            "echo": r.normal(0, 0.3, (ECHO, EMBED)).astype(np.float32),
            "filters": r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, FILTERS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def tables(self) -> np.ndarray:
        """What each byte with its class of distance adds, at each place of a window, to each filter."""
        both = self.p["byte"][:, None] + self.p["echo"][None]
        return np.einsum("be,kef->kbf", both.reshape(-1, EMBED), self.p["filters"])

    def windows(self, b: np.ndarray, echo: np.ndarray, tables) -> np.ndarray:
        n = (len(b) - WIDTH) // STRIDE + 1
        seen = b.astype(np.intp) * ECHO + echo
        out = np.repeat(self.p["bias"][None], n, 0)
        for k in range(WIDTH):
            out += tables[k].take(seen[k : k + (n - 1) * STRIDE + 1 : STRIDE], 0)
        return out

    def chunks(self, b: np.ndarray, echo: np.ndarray, tables, where: bool = False):
        """The largest value of each filter in each chunk, and in which window it is."""
        values, places = [], []
        step, total = WINDOWS * AT_ONCE, (len(b) - WIDTH) // STRIDE + 1
        for first in range(0, total, step):
            last = min(total, first + step)
            part = slice(first * STRIDE, (last - 1) * STRIDE + WIDTH)
            w = self.windows(b[part], echo[part], tables)
            edges = np.arange(0, len(w), WINDOWS)
            values.append(np.maximum.reduceat(w, edges))
            if where:
                places += [first + e + w[e : e + WINDOWS].argmax(0) for e in edges]
        return np.concatenate(values), places

    def features(self, chunk_values: np.ndarray) -> np.ndarray:
        return np.maximum(chunk_values, 0).max(0)

    def score(self, text: str, tables) -> float:
        values, _ = self.chunks(*symbols(text), tables)
        z = float(self.features(values) @ self.p["out"] + self.p["out_bias"][0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, seen: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> dict[str, np.ndarray]:
        tables, g = self.tables(), {k: np.zeros_like(v) for k, v in self.p.items()}
        columns = np.arange(FILTERS)
        for (b, echo), label in zip(seen, labels, strict=True):
            values, places = self.chunks(b, echo, tables, True)
            relu = np.maximum(values, 0)
            feats = self.features(values)
            z = np.clip(feats @ self.p["out"] + self.p["out_bias"][0], -30, 30)
            d = float(1 / (1 + np.exp(-z)) - label) / len(labels)
            g["out"] += d * feats
            g["out_bias"] += d
            dv = np.zeros_like(values)
            dv[relu.argmax(0), columns] = d * self.p["out"]
            dv[values <= 0] = 0
            g["bias"] += dv.sum(0)
            at = np.asarray(places) * STRIDE  # chunk, filter -> first byte of the window
            for k in range(WIDTH):
                x, y = b[at + k], echo[at + k]
                both = self.p["byte"][x] + self.p["echo"][y]
                g["filters"][k] += np.einsum("cfe,cf->ef", both, dv)
                back = dv[:, :, None] * self.p["filters"][k].T[None]
                np.add.at(g["byte"], x.ravel(), back.reshape(-1, EMBED))
                np.add.at(g["echo"], y.ravel(), back.reshape(-1, EMBED))
        return g

    def train(self, labelled: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
        seen, labels = [symbols(t) for t, _ in labelled], [y for _, y in labelled]
        r, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        epochs = max(epochs, -(-STEPS // -(-len(seen) // BATCH)))
        total = epochs * -(-len(seen) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(seen))
            for k in range(0, len(order), BATCH):
                some, step = order[k : k + BATCH], step + 1
                rate = RATE * (1 - step / (total + 1))
                for name, g in self.gradients([seen[i] for i in some], [labels[i] for i in some]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] = (self.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


class Constant(Network):
    """Says the same of every text."""

    def __init__(self, share: float) -> None:
        super().__init__()
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.p["out"][:] = 0
        self.p["out_bias"][:] = np.log(share / (1 - share))


def held_out(doc_id) -> F.Column:
    """Whether no label of this row may be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> Network:
    """A network trained on the labelled rows that are not held out."""
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = labels.where(~held_out("doc_id") & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(order, "doc_id", "quality").limit(most_rows)
    text = F.coalesce("text", F.lit("")).alias("text")
    some = docs.select("doc_id", text).join(F.broadcast(rows), "doc_id").withColumn("h", F.xxhash64("text"))  # most_rows rows of two numbers
    # ids may be repeated in either table: the limit counts again after the join
    sizes = some.select("doc_id", "quality", "h", F.length("text").alias("n")).orderBy(order, "doc_id", "quality", "h").limit(most_rows).collect()
    kept, chars = set(), 0
    for r in sizes:
        if chars + r["n"] <= most_chars and (r["doc_id"], r["h"]) not in kept:
            kept.add((r["doc_id"], r["h"]))
            chars += r["n"]
    if not kept:
        return Constant(0.5)
    chosen = docs.sparkSession.createDataFrame(sorted(kept), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long")
    found = some.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "quality"]).select("text", "quality")
    labelled = sorted((r["text"], r["quality"]) for r in found.collect())
    ones = sum(y for _, y in labelled)
    if ones in (0, len(labelled)):
        return Constant(ones / len(labelled))
    return Network().train(labelled)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tables: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = shared.value
        if not tables:
            tables.append(net.tables())
        got = np.asarray([net.score(t, tables[0]) for t in texts(batch.column(2))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(by_batch(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of docs that the network gives label 1, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")
    tables: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            tables.append(shared.value.tables())
        return batch.filter(pa.array([shared.value.score(t, tables[0]) >= 0.5 for t in texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(by_batch(run), docs.schema)
