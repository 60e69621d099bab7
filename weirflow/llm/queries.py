"""The queries of this folder: each applies one operator, with the parameters of production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, fingerprints, lines, mixing, ngrams, pii, quality
from .common import table
from .packing import pack_documents
from .token_files import token_files

#: A conversation whose texts look like marks of templates.
HOSTILE = (-7, "\\### Assistant: </turn> ok")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), whole_lines=False).select("doc_id", "text", "n_lines", "n_cut", "cut")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_join(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(table(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turn_rows(table(spark, sf_dir, "conversations"))
    key, text = HOSTILE
    hostile = spark.range(2).select(F.lit(key).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    out = chat.format_rows(rows.unionByName(hostile))
    read = out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_ngram_join, op3_fingerprints, op4_packing, op5_pii, op6_embeddings, op7_chat, op8_mixing, op9_quality, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op6_embeddings": OP6_SQL, "op7_chat": OP7_SQL}


#: All pairs that share a run of five words, and what can be reached from each document by links.
OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as ws from documents), g as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)), n as (
  select doc_id, count(*) as n from g group by 1), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all), links as (
  select a, b, c = x.n and c = y.n as same from pairs join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9), reach as (
  select doc_id as a, doc_id as c from documents union select r.a, l.b from reach r join links l on l.a = r.c), classes as (
  select a, min(c) as class_id from reach group by 1), counts as (
  select a, count(*) as n_links, min(b) filter (same) as twin from links group by 1)
select doc_id, class_id, coalesce(n_links, 0) as n_links, least(doc_id, coalesce(twin, doc_id)) as set_id
from documents join classes on classes.a = doc_id left join counts on counts.a = doc_id
"""

#: All pairs by cosine, and what can be reached from each vector by links.
OP6_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95), reach as (
  select vec_id as a, vec_id as c from v union select r.a, l.b from reach r join links l on l.a = r.c), counts as (
  select a, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from (select a as vec_id, min(c) as component_id from reach group by 1) left join counts on counts.a = vec_id
"""


#: The same digests from the rows themselves. The length of the formatted text is that of the texts, of the marks (17 code points and the role a turn), and one more for each escaped character.
OP7_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(17 + length(role) + length(text)
    + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))
    + length(role) - length(replace(role, '>', ''))) as bigint) as formatted_chars
from rows group by conv_id
"""
