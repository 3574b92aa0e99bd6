"""Registered queries opN_<name> and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, decontaminate, divergence, jaccard, language, merkle, mixture, quality_model, quality_rules, secret_scan, sharding, substrings, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return keep


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(encoded_and_decoded: DataFrame) -> list:
    return [
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    ]


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer()), tokenizer())
    return decoded.select("doc_id", "n_tokens", *token_digests(decoded))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer())


@query(quality_rules.ORACLE)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among eight shards whose row counts are at most one apart."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.learn(documents))


@query()
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")


@query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base findings and those of the network."""
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.scan(documents, secret_scan.learn(documents))
    base = F.filter("findings", lambda x: x["kind"] != "model")
    return found.select(
        "doc_id",
        *[_count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"),
    )


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the passages it holds."""
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, and its component of documents linked by similarity."""
    return jaccard.link(table(spark, sf_dir, "documents"))


@query(substrings.ORACLE)
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, and what is left without repeated passages."""
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query(merkle.ORACLE)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and where a tampered text leads."""
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.without_line_breaks())


@query(mixture.ORACLE)
def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(divergence.ORACLE)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are from each other, and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))
