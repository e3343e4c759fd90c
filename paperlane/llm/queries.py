"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontamination, importance, masked_lm, mixing, spelling
from .bpe import encode
from .fingerprints import fingerprints, within_radius
from .ngram_join import near_duplicates
from .pii import digests, personal_data
from .quality import judged
from .shared import left_join, table, written
from .token_counts import token_counts
from .toxicity import toxicity


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, installed beside the tokenizer libraries on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. Null and empty texts have 0 shingles and are components of their own; rows without an id have none."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Empty and null texts get the model's bias; ids may repeat or be null."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base_failed, kept and the rule that rejects, of every document. Null texts count as empty, and fail for want of words."""
    out, _ = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document; null and empty texts have none."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call, result and message of all conversations, in the form that ``exchanges`` gives them, linked and ordered."""
    return chat.linked(chat.exchanges(table(spark, sf_dir, "conversations")))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of other distinct fingerprints of the table within the registered radius."""
    prints = fingerprints(table(spark, sf_dir, "documents"))
    near = within_radius(prints).select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_near"))
    return left_join(prints, written(near, "near"), ["fingerprint"]).withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word of every document; texts without words have 0, 0.0 and null."""
    return masked_lm.scored(table(spark, sf_dir, "documents"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document; null and empty texts have no ids."""
    return encode(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document. Null sources are one source; null texts have size 0."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the fixed forms, their digest and all spans of every document; null and empty texts hold none."""
    return digests(personal_data(table(spark, sf_dir, "documents"), carried=("doc_id",)))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; null and empty texts have no features, and documents of fewer than 20 words no rank."""
    rows = importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=("doc_id",))
    return rows.select("row.doc_id", "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least 7 letters that occurs twice or more in all documents; null and empty texts have none."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; null and empty texts have no words. Repeated rows have a result each."""
    return decontamination.digests(decontamination.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carried=["doc_id"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_quality_rules, op4_token_counts, op5_chat_formatting, op6_document_fingerprints, op7_lm_scoring, op8_bpe_encoding, op9_mixing, op10_pii, op11_importance_resampling, op12_spelling_variants, op13_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": chat.ORACLE, "op9_mixing": mixing.ORACLE, "op11_importance_resampling": importance.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_decontamination": decontamination.ORACLE}
