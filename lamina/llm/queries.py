"""The queries `opN_<name>` of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import blocklabel, bytebpe, langid, licenses, neardup, oracles, packing, quality, secrets, sharding, spotsigs
from lamina.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return blocklabel.extract(table(spark, sf_dir, "pages"))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return spotsigs.compare(table(spark, sf_dir, "documents"))


def op3_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices that the documents hold."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of at most `sharding.LIMIT` bytes."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict on every document."""
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    return bytebpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned into an empty ledger and joined back."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.scan(docs))


QUERIES: tuple[Query, ...] = (
    op1_block_labeller,
    op2_spot_signatures,
    op3_license_bands,
    op4_best_fit_packing,
    op5_extendible_hashing,
    op6_line_frequency,
    op7_byte_bpe,
    op8_minhash_join,
    op9_language_filters,
    op10_secret_ledger,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        op6_line_frequency.__name__: oracles.line_frequency(),
        op8_minhash_join.__name__: oracles.near_duplicates(),
        op10_secret_ledger.__name__: oracles.secret_ledger(),
    }
