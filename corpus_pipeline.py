"""From documents to packed training sequences, in five stages; each stage's result is written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the last return the
columns of documents: toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, personal data is replaced by its kind in brackets, and what remains is tokenised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.core import materialise, table
from tarmac.llm import decontaminate, packing, pii, simhash, toxicity
from tarmac.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked fingerprints, and of texts that share most of their shingles."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced in their texts."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]

#: SQL can't train the models or compare edit distances; the tests hold each stage against documents planted for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
