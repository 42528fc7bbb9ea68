"""The queries of this subpackage: one for each operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation, exact_dedup, license_scan, lm_score, near_dedup, packing, phrases, quality, reshard, sentence_pieces, token_store, toxicity
from .common import scratch, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the tables of this machine's tokenizers are a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/shards-{uuid.uuid4().hex}"
    return reshard.digest(reshard.resharded(table(spark, sf_dir, "documents"), path, shards=40))


def op5_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024))


def op7_huffman_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(sentence_pieces.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"), order=2)  # triples take more disk than the check tool grants: see README


def op11_conversation_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.digest(conversation.repaired(conversation.damaged(table(spark, sf_dir, "conversations"))))


def op12_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op13_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_classifier, op3_block_matrix_ann, op4_flow_reshard, op5_block_naming_dedup, op6_differencing_packing, op7_huffman_store, op8_sentence_pieces, op9_minhash_dedup, op10_backoff_lm, op11_conversation_viterbi, op12_setm_phrases, op13_toxicity_grammar)}


def oracle_sql() -> dict[str, str]:
    return {"op3_block_matrix_ann": ann.ORACLE_SQL, "op5_block_naming_dedup": exact_dedup.ORACLE_SQL, "op11_conversation_viterbi": conversation.ORACLE_SQL, "op12_setm_phrases": phrases.ORACLE_SQL}
