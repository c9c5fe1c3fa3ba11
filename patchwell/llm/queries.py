"""The registered queries of this subpackage, each over its whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, fingerprints, language_id, licenses, neighbours, packing, quality, repair, sharding, simhash, suffixes, token_counts, tries
from .common import crc32, held_out, materialize, table

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 24


def language_model(spark: SparkSession, sf_dir: str) -> language_id.LanguageModel:
    return language_id.train(table(spark, sf_dir, "documents").where(~held_out()))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, the second one sent twice: inserts, deletes of copies, counts without addresses."""
    rows = materialize(token_counts.counted(table(spark, sf_dir, "documents")), "counted")
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit(1, token_counts.inserts(rows))
    rollup.commit(2, token_counts.deletes_of_copies(rows))
    rollup.commit(2, token_counts.deletes_of_copies(rows))
    rollup.commit(3, token_counts.revisions(rows))
    return rollup.totals()


OP2_SQL = r"""
with counted as (
  select doc_id, source, lang, coalesce(text, '') as t, row_number() over (partition by coalesce(text, '') order by doc_id nulls last, source nulls first, lang nulls first) as n,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*')) as a,
         (strlen(coalesce(text, '')) + 3) // 4 as b
  from documents),
groups as (
  select source, lang, 'words.1' as version, case when n = 1 then 1 else 0 end as docs, case when n = 1 then w - a else 0 end as tokens from counted
  union all
  select source, lang, 'bytes4.1', case when n = 1 then 1 else 0 end, case when n = 1 then b else 0 end from counted)
select source, lang, version, cast(sum(docs) as bigint) as docs, cast(sum(tokens) as bigint) as tokens from groups group by all
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return sharded.select("doc_id", "size", crc32(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def op7_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), query=F.col("vec_id") % 20 == 0, k=20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.deduplicated(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_language_id, op2_token_rollup, op3_best_fit_packing, op4_quality, op5_license_scan, op6_histogram_shards, op7_lookup_sketch, op8_hilbert_neighbours, op9_simhash, op10_bpe_codec, op11_suffix_dedup,
    op12_prefix_trie, op13_structure_repair)}
SQL: dict[str, str] = {"op2_token_rollup": OP2_SQL}
