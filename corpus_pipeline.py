"""The corpus pipeline: documents that the quality classifier keeps, without repeated lines and near copies, mixed to target weights and packed.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import lines, mixing, ngrams, packing, quality
from weirflow.llm.common import dropped, free, new_folder, parts, settle, table

#: Copies of a document that one task makes.
MOST_COPIES = 1024

#: SQL has no convolutional network to learn, so run()'s rows have none.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of words go from the later documents, and documents of which nothing is left."""
    # the operator's own columns come last, so a document's columns may have their names
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = f"c{docs.columns.index('text')}"
    out = lines.dedup(docs.toDF(*names), id_col=f"c{docs.columns.index('doc_id')}", text_col=text, whole_lines=False)
    left = out.where((F.col("cut") == "") | F.col(text).rlike(r"\S"))
    return left.select(*((F.length(text).cast("long") if c == "n_chars" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word runs hold together, the one with the smallest id stays (null after all ids; of one id, by a hash of the text). Documents that nothing links stay, whatever their ids; those without words link with nothing."""
    first_id, first, key, wordless, own = free(docs, "first_id", "first", "key", "wordless", "own")
    rows = ngrams.linked(docs.select("doc_id", "text"))
    stays = rows.where("first_row is null or (doc_id <=> class_id and row = first_row)").select(F.col("doc_id").alias(first_id), F.col("row").alias(first), F.col("first_row").isNull().alias(wordless)).distinct()
    keyed = docs.withColumn(key, ngrams.row_key("doc_id", "text"))
    left = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(key) == F.col(first)))
    # rows with one id and text are near copies too, if they have words
    left = left.withColumn(own, F.when(F.col(wordless), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return left.groupBy(first_id, first, own).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(key)).select(f"{key}.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it. Rows that are the same in all columns are one document that is taken as often as they are together."""
    key, row, copies = free(docs, "key", "row", "copies")
    keyed = docs.withColumn(key, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    mixed = mixing.mix(keyed.select(key, "source", "text"), id_col=key)
    times = settle(mixed.groupBy(key).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0))
    one = keyed.groupBy(key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row)).join(times, key)
    most = times.agg(F.max(copies)).first()[0] or 0
    if most > MOST_COPIES:  # several tasks make the copies of one document
        one = one.withColumn(key, F.explode(F.sequence(F.lit(0), F.col(copies) - 1, F.lit(MOST_COPIES)))).withColumn(copies, F.least(F.lit(MOST_COPIES), F.col(copies) - F.col(key))).repartition(parts(spark))
    return one.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(f"{row}.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near copies", near_copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, from the documents in sf_dir. Each stage's result is deleted when the next one has read it."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:  # the stage has read it
            dropped(spark, f"{folder}/{k - 1}")
    return docs
