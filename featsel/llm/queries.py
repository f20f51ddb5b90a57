"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module with `query(spark, sf_dir)` and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_quality_classifier": "quality",
    "op2_url_filters": "url_filters",
    "op3_toxicity": "toxicity",
    "op4_source_mixing": "source_mixing",
    "op5_minhash_dedup": "minhash_dedup",
    "op6_ann_multiprobe": "ann",
    "op7_bpe": "bpe",
    "op8_fingerprints": "fingerprints",
    "op9_substring_dedup": "substring_dedup",
    "op10_license_scans": "short_notices",
    "op11_vector_codes": "vector_codes",
    "op12_collocations": "collocations",
    "op13_embedding_dedup": "embedding_dedup",
}


def queries() -> dict:
    return {name: import_module(f"featsel.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"featsel.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
