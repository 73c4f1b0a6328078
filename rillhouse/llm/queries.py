"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard, langid, manifest, mixing, pii, quality, secrets, simhash, spelling, toxicity, warc
from .common import table


def tokenizer() -> tuple[str, str]:
    """Rank file and splitting pattern of the default tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = toxicity.grade(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return graded.select("doc_id", "toxicity.*", (~F.col("toxicity.toxic")).alias("kept"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def _of_kind(spans: Column, kind: int) -> Column:
    """How many spans are of a kind. (A second parameter of the lambda would be the place in the array.)"""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    counts = [_of_kind(base, k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    added = _of_kind(spans, 3).alias("n_markov")
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"), added)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return named.select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.scan(docs, pii.train(docs))
    base, spans = F.col("pii.base"), F.col("pii.spans")
    counts = [_of_kind(base, k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encoded(docs: DataFrame) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs, *tokenizer(), keep=["doc_id"]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), percent=85, shingle=4)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_fingerprints, op3_secrets, op4_language, op5_quality, op6_warc, op7_pii, op8_mixing, op9_bpe, op10_simhash, op11_jaccard, op12_spelling, op13_manifest)
    return {f.__name__: f for f in found}


#: Digests, types and references of the archive query, from the pages alone.
OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.kept IS NOT NULL AND p.page_id <> g.kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> g.kept THEN g.kept END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL}
