"""The queries of the numbered operators and of the pipeline, and their SQL where SQL can express one."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage with ``query(spark, sf_dir)``.
MODULES = {
    "op1_embedding_dedup": "op1_embedding_dedup",
    "op2_bpe": "op2_bpe",
    "op3_ngram_join": "op3_ngram_join",
    "op4_language_id": "op4_language_id",
    "op5_personal_data": "op5_personal_data",
    "op10_quality_classifier": "op10_quality_classifier",
    "op6_sharding": "op6_sharding",
    "op7_mixing": "op7_mixing",
    "op8_line_dedup": "op8_line_dedup",
    "op9_quality_rules": "op9_quality_rules",
    "op11_license_scan": "op11_license_scan",
    "op12_whitening": "op12_whitening",
    "op13_merkle_manifest": "op13_merkle_manifest",
}


def queries() -> dict:
    found = {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    from trialgrid.llm.oracles import SQL

    return dict(SQL)
