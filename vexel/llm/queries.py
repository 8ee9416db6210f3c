"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import audit, bpe, html, langid, maxscore, mixing, oracles, pii, repair, resample, sharding, simhash, toxicity, winnow
from vexel.llm.common import table


def op1_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.page_texts(table(spark, sf_dir, "pages"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by its key."""
    return sharding.shard_digest(table(spark, sf_dir, "documents"), 16)


def op3_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.languages(table(spark, sf_dir, "documents"))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    return pii.found_pii(table(spark, sf_dir, "documents"))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate group of every document: shingles of four words, at most four differing bits."""
    return simhash.groups_digest(table(spark, sf_dir, "documents"), 4, 4)


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of each vector whose id is divisible by 50."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), 50, 5)


def op7_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, written in compressed blocks and read back."""
    import public_tokenizers

    return repair.token_digest(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order of the five filters and step over all documents."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark, its score, and its rank if it is drawn."""
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_text_tag_ratio": op1_text_tag_ratio,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_subword_language": op3_subword_language,
    "op4_bootstrapped_pii": op4_bootstrapped_pii,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_maxscore": op6_maxscore,
    "op7_factorization_toxicity": op7_factorization_toxicity,
    "op8_winnowing": op8_winnowing,
    "op9_repair_tokens": op9_repair_tokens,
    "op10_entropy_mixing": op10_entropy_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op2_jump_sharding": oracles.OP2,
    "op6_maxscore": oracles.OP6,
    "op8_winnowing": oracles.OP8,
    "op11_filter_audit": oracles.OP11,
    "op13_importance_resampling": oracles.OP13,
}
