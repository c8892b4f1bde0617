"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = [
    "mixing", "packing", "license_scan", "topk", "chat_format", "lm_score", "near_dedup", "exact_dedup", "language_id", "line_dedup",
    "periodic_runs", "decontamination", "collocations",
]


def _modules():
    return [importlib.import_module(f"lamella.llm.{m}") for m in MODULES]


def queries():
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
