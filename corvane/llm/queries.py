"""The registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from . import changepoints, decontam, infill, langid, licenses, linededup, packing, simhash, suffix, tokencount, topk, toxicity, urlfilter
from ._common import table


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": lambda spark, d: simhash.digest(table(spark, d, "documents")),
        "op2_language_id": lambda spark, d: langid.digest(table(spark, d, "documents")),
        "op3_exact_top_k": lambda spark, d: topk.digest(table(spark, d, "embeddings")),
        "op4_license_scan": lambda spark, d: licenses.digest(table(spark, d, "documents")),
        "op5_best_fit_packing": lambda spark, d: packing.digest(table(spark, d, "documents")),
        "op6_line_dedup": lambda spark, d: linededup.digest(table(spark, d, "documents")),
        "op7_suffix_array_dedup": lambda spark, d: suffix.digest(table(spark, d, "documents")),
        "op8_benchmark_decontamination": lambda spark, d: decontam.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op9_url_filter": lambda spark, d: urlfilter.digest(table(spark, d, "pages")),
        "op10_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_token_counts": lambda spark, d: tokencount.digest(table(spark, d, "documents")),
        "op12_fill_in_middle": lambda spark, d: infill.digest(table(spark, d, "documents")),
        "op13_change_points": lambda spark, d: changepoints.digest(table(spark, d, "sale_lines")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": topk.DIGEST_SQL,
        "op4_license_scan": licenses.digest_sql(),
        "op6_line_dedup": linededup.DIGEST_SQL,
        "op8_benchmark_decontamination": decontam.DIGEST_SQL,
        "op9_url_filter": urlfilter.digest_sql(),
        "op12_fill_in_middle": infill.DIGEST_SQL,
        "op13_change_points": changepoints.DIGEST_SQL,
    }
