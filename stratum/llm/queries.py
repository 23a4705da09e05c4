"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from stratum.llm import bpe, collocations, fm_index, license_scan, ngram_join, packing, pii, quality_rules, sharding, toxicity, turn_repair, url_filter, warc

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_warc_zstd": warc.query,
    "op3_bpe": bpe.query,
    "op4_url_filters": url_filter.query,
    "op5_quality_rules": quality_rules.query,
    "op6_benchmark_decontamination": fm_index.query,
    "op7_pii": pii.query,
    "op8_license_scans": license_scan.query,
    "op8_license_texts": license_scan.query_texts,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_toxicity": toxicity.query,
    "op11_conversation_repair": turn_repair.query,
    "op12_packing": packing.query,
    "op13_collocations": collocations.query,
}
SQL = {
    "op2_warc_zstd": warc.SQL,
    "op1_sharding": sharding.sql(),
    "op4_url_filters": url_filter.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_benchmark_decontamination": fm_index.SQL,
    "op8_license_scans": license_scan.sql(),
    "op9_ngram_jaccard_join": ngram_join.SQL,
    "op11_conversation_repair": turn_repair.SQL,
    "op13_collocations": collocations.SQL,
}
