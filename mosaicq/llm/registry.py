"""The queries of this subpackage and their SQL."""

from mosaicq.llm import decontam, exact_dedup, language_id, license_scan, line_dedup, merkle_manifest, ngram_join, packing, periodic_runs, pii, quality, quote_links, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_quote_linking": quote_links.op3_quote_linking,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE = {
    "op4_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
