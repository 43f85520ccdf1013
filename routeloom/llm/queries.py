"""Queries of this subpackage for the entry module: name -> (module, function)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES = {
    "op1_ngram_jaccard_join": ("jaccard_join", "op1"),
    "op2_decontamination": ("decontaminate", "op2"),
    "op3_kneser_ney": ("kneser_ney", "op3"),
    "op4_secret_links": ("secrets", "op4"),
    "op5_nb_svm_quality": ("quality", "op5"),
    "op9_word_backoff_language": ("language_id", "op9"),
    "op10_line_dedup": ("line_dedup", "op10_runs"),
    "op10_repeated_lines": ("line_dedup", "op10_lines"),
    "op6_sentencepiece_fst": ("sentencepiece_fst", "op6"),
    "op7_license_dice": ("licenses", "op7"),
    "op7_license_windows": ("licenses", "op7_windows"),
    "op8_anisotropic_ann": ("anisotropic", "op8"),
    "op11_token_alignment": ("token_alignment", "op11"),
    "op12_mix_sources": ("mixing", "op12"),
    "op13_conversation_repair": ("conversation_repair", "op13"),
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import conversation_repair, licenses, line_dedup, mixing

    return {"op7_license_dice": licenses.oracle(), "op10_repeated_lines": line_dedup.ORACLE, "op12_mix_sources": mixing.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
