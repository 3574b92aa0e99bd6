"""Corpus pipeline: documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that
the stage before it kept. All but the last return the columns of docs.

1. quality_rules drops documents that the rules reject.
2. ngram_jaccard keeps of each component of similar documents the one with the smallest doc_id.
3. decontamination drops documents that hold a benchmark passage.
4. secret_scan replaces every finding in the text by a mark; n_chars follows.
5. bpe encodes what is left, and decodes it again.

Null texts count as empty (and leave at the first stage); a null doc_id is like any other in
the stages that judge rows, and is never dropped by those that judge ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, decontaminate, jaccard, quality_rules, secret_scan
from scholia.llm.queries import token_digests, tokenizer

#: DuckDB can't express the latent search, the network and the merges; tests hold each stage to brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the ids dropped: the ids, not the texts, are the side that is held in memory."""
    ids = dropped.select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(ids.hint("shuffle_hash"), docs["doc_id"] == ids["_dropped"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, jaccard.link(docs).where("component_id <> doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.search(docs, benchmark))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.scan(docs, secret_scan.learn(docs), keep=tuple(docs.columns), mark="[secret]")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer())
    return decoded.select("doc_id", "n_tokens", *token_digests(decoded), F.base64("ids").alias("ids_base64"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
