"""Stages that turn raw documents into token ids. Each takes (spark, docs, sf_dir) and works on all
that the stage before kept; run() writes each stage's rows as Parquet in the shared folder and
hands them on. All but the last return the columns of `documents`, further ones with them,
whatever their names; texts of any length are taken whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillhouse.llm import mixing, pii, simhash, toxicity
from rillhouse.llm.common import materialize, table
from rillhouse.llm.queries import encoded


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not find toxic. Null, empty and wordless texts stay;
    repeated rows fare alike; no rows, or no labels, take nothing away."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest id, nulls last; null and blank
    texts make one component; of repeated rows one stays; no rows give none."""
    return simhash.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its type. Null texts stay null, empty ones empty;
    repeated rows stay; no rows give none."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: blank and null texts have no words and are not
    drawn; repeated rows count each; no rows give none."""
    return mixing.draw(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of each document drawn. Texts of any
    length are encoded whole; null ones have no ids; no rows give none."""
    return encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Models, hashes and merges are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
