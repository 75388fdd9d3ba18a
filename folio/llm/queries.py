"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import chat_format, decontamination, fingerprint, kneser_ney, ngram_join, packing, prefix_trie, quality, secret_scan, substring_dedup, token_file, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_quality": quality.op2_quality,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
        "op7_token_file": token_file.op7_token_file,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_kneser_ney": kneser_ney.op9_kneser_ney,
        "op10_warc": warc.op10_warc,
        "op11_chat_format": chat_format.op11_chat_format,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; tests compare the others with brute force, round trips and held-out rows."""
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op5_secret_scan": secret_scan.SQL,
        "op6_ngram_jaccard": ngram_join.SQL,
        "op8_decontamination": decontamination.SQL,
        "op10_warc": warc.SQL,
        "op11_chat_format": chat_format.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
    }
