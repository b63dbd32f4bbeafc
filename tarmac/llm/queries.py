"""The queries opN_<name> and pipeline: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.core import at_exit, scratch_path, table
from tarmac.llm import ann, decontaminate, infill, manifest, packing, pii, preference, quality, simhash, substrings, token_counts, token_files, toxicity
from tarmac.llm.common import fold


def vocabulary(name: str) -> str:
    """Where a public tokenizer file is; the files stay outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenise(docs, vocabulary("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.pack(pieces, packing.groups_for(docs))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model that learned from the training folds only."""
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found for every vec_id divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"))
    return ann.nearest(vectors, queries)


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation against its made-up negative."""
    return preference.rendered(preference.with_negatives(table(spark, sf_dir, "conversations")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece count of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds within the edit budget."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model that learned from the training folds only."""
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to documents with smaller ids, and the digest of what remains."""
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root in the manifest, and whether the tampered document still leads to that root."""
    return manifest.verified(manifest.proofs(table(spark, sf_dir, "documents"), manifest.tampered()))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut lengths and digests of every document with its middle moved to the end."""
    return infill.digest(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest in the compressed token files, read back from them."""
    folder = scratch_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    at_exit(spark, folder)
    return token_files.digest(token_files.read(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_pii, op3_quality, op4_nearest, op5_preference, op6_token_counts, op7_decontamination, op8_toxicity, op9_simhash, op10_repeats, op11_manifest, op12_infill, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op5_preference": preference.ORACLE, "op11_manifest": manifest.ORACLE, "op12_infill": infill.ORACLE}
