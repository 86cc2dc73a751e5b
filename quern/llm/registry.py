"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name to the module whose ``query`` it is.
MODULES = {
    "op1_secrets": "secrets",
    "op2_substring_dedup": "substrings",
    "op3_url_filter": "urls",
    "op4_ann": "ann",
    "op5_pii": "pii",
    "op6_decontamination": "decontamination",
    "op7_toxicity": "toxicity",
    "op8_language_id": "language",
    "op9_mixing": "mixing",
    "op10_minhash": "minhash",
}


def queries() -> dict:
    import corpus_pipeline

    out = {name: importlib.import_module(f"quern.llm.{m}").query for name, m in MODULES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from quern.llm import oracles

    return oracles.SQL
