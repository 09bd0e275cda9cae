"""Registry of this subpackage: queries and their SQL, by name."""

from __future__ import annotations

from . import op1_best_fit_packing, op2_tag_path_ratios, op3_suffix_repetition, op4_byte_bpe, op5_crf_toxicity, op6_kd_sharding, op7_hierarchical_langid, op8_bayes_jaccard_join, op9_metric_range_join, op10_line_dedup, op11_importance_resampling, op12_warc_zstd, op13_periodic_runs

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing.query,
    "op2_tag_path_ratios": op2_tag_path_ratios.query,
    "op3_suffix_repetition": op3_suffix_repetition.query,
    "op4_byte_bpe": op4_byte_bpe.query,
    "op5_crf_toxicity": op5_crf_toxicity.query,
    "op6_kd_sharding": op6_kd_sharding.query,
    "op7_hierarchical_langid": op7_hierarchical_langid.query,
    "op8_bayes_jaccard_join": op8_bayes_jaccard_join.query,
    "op9_metric_range_join": op9_metric_range_join.query,
    "op10_line_dedup": op10_line_dedup.query,
    "op11_importance_resampling": op11_importance_resampling.query,
    "op12_warc_zstd": op12_warc_zstd.query,
    "op13_periodic_runs": op13_periodic_runs.query,
}

SQL = {
    "op8_bayes_jaccard_join": op8_bayes_jaccard_join.SQL,
    "op9_metric_range_join": op9_metric_range_join.SQL,
    "op10_line_dedup": op10_line_dedup.SQL,
    "op11_importance_resampling": op11_importance_resampling.SQL,
    "op12_warc_zstd": op12_warc_zstd.SQL,
    "op13_periodic_runs": op13_periodic_runs.SQL,
}
