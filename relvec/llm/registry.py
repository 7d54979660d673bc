"""Queries of this package and the SQL that checks them."""

from relvec.llm import (
    adaptive_scan, columnar_topk, license_scan, mixing, odd_sketch, one_bit_mining, paragraph_lookup, periodic_runs,
    piece_sampling, secret_scan, suffix_dedup, token_files, toxicity,
)

MODULES = (
    mixing, toxicity, suffix_dedup, paragraph_lookup, piece_sampling, adaptive_scan, secret_scan, odd_sketch, license_scan, token_files,
    columnar_topk, one_bit_mining, periodic_runs,
)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
