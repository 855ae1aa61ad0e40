"""Registered queries of this subpackage, over whole tables with production parameters, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmap.llm import bpe, collocations, decontaminate, html, jaccard, lm, merkle, quality, secrets, substrings, token_files, tokens, toxicity

#: The vocabulary that token counts and byte-pair coding use.
VOCABULARY = "word_bpe_49k.json"
#: The vocabulary of token files.
BYTE_VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.train(pages))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.tampered_manifest(table(spark, sf_dir, "documents"))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_toxicity, op2_token_counts, op3_bpe, op4_substring_dedup, op5_quality_rules, op6_html_extraction, op7_lm_scores, op8_jaccard_join, op9_decontamination, op10_secrets, op11_merkle_manifest, op12_token_files, op13_collocations)
}

ORACLES: dict[str, str] = {"op11_merkle_manifest": merkle.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
