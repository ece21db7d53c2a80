"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

from tokenloom.llm.sql import ORACLE

_BY_MODULE = {
    "bpe": "op2_byte_bpe",
    "simhash": "op10_simhash",
    "suffixes": "op6_suffix_dedup",
    "lines": "op4_line_dedup",
    "winnow": "op8_winnowing",
    "urls": "op7_url_filter",
    "media": "op9_media_columns",
    "licenses": "op3_license_scan",
    "quality": "op1_quality",
    "packing": "op5_best_fit_packing",
    "partenum": "op11_jaccard_join",
    "codes": "op12_vector_codes",
    "resample": "op13_resampling",
}


def _load(module: str, name: str):
    return getattr(importlib.import_module(f"tokenloom.llm.{module}"), name)


QUERIES = {name: _load(module, name) for module, name in _BY_MODULE.items()}
QUERIES["media_pages"] = _load("media", "media_pages")  # op9's parser over the real pages, which refer to no media
ORACLE_SQL = {name: sql for name, sql in ORACLE.items() if name in QUERIES or name == "pipeline"}
