"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.decontam import CONTAMINATION_SQL, contamination_report
from larkspur.llm.frames import scratch_path, table
from larkspur.llm.hamming import TOP_K_SQL, hamming_top_k, sign_codes
from larkspur.llm.htmlmain import extract_main_text
from larkspur.llm.licenses import license_report, licenses_sql
from larkspur.llm.mixing import MIXTURE_SQL, mixture
from larkspur.llm.neardup import near_duplicates, near_duplicates_sql
from larkspur.llm.quality import judge
from larkspur.llm.secretscan import secret_report, secrets_sql
from larkspur.llm.tokenstore import read_tokens, write_tokens
from larkspur.llm.urlrules import RULES, VERDICTS_SQL, rules_frame, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_report(table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 80 % of their four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 20, among all vectors."""
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_top_k(codes, codes.filter("id % 20 = 0"), k=10)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notice of every document."""
    return license_report(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sampling of all documents to the sources' target weights."""
    return mixture(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the passage."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Simple-8b segments of token ids, and what reading them back gives."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=2)
    return read_tokens(spark, path)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return url_verdicts(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_hamming_topk": op2_hamming_topk,
        "op3_license_scan": op3_license_scan,
        "op4_source_mixing": op4_source_mixing,
        "op5_secret_scan": op5_secret_scan,
        "op6_minhash_neardup": op6_minhash_neardup,
        "op7_html_extraction": op7_html_extraction,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_token_output": op9_token_output,
        "op10_url_rules": op10_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_hamming_topk": TOP_K_SQL,
        "op3_license_scan": licenses_sql(),
        "op4_source_mixing": MIXTURE_SQL,
        "op5_secret_scan": secrets_sql(),
        "op6_minhash_neardup": near_duplicates_sql(4, 80),
        "op8_benchmark_decontamination": CONTAMINATION_SQL,
        "op10_url_rules": VERDICTS_SQL,
    }
