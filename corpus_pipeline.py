"""From documents to token ids: toxic texts go, one of each group of near copies stays, sources are mixed to their target
weights, and the mix is encoded. Each stage reads what the one before it has written.

In every stage a null text counts as an empty one, an empty table gives an empty table, and rows of equal doc_id are rows of
their own. The first three stages return all columns of their input, whatever their names, and leave further columns as
they are; the last one reads doc_id and text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, dedup, mixing, toxicity
from tidemark.llm.common import new_path


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is 0.5 or more, with all their rows. Empty texts and texts of unknown words have little
    evidence and stay; without labels of both kinds everything stays. A score of exactly 0.5 is rejected."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts linked by a five-word Jaccard similarity of 0.8 or more: the least doc_id, a
    null one after all others, of equal ones the first row. All texts without words are copies of one another."""
    return dedup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: once for each pass that takes words of theirs. Texts without words are never taken; a
    null source is a source of its own."""
    return mixing.mixed_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids, of every row; an empty text has no ids."""
    return bpe.round_trip(docs, bpe.default_path(), with_ids=True)


STAGES = [("toxicity", toxic_texts), ("near_copies", near_copies), ("source_mix", source_mix), ("token_ids", token_ids)]

#: SQL has no hash of XXH64 kind, no fitted model and no BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := new_path(spark, f"pipeline-{name}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
