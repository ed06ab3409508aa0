"""The queries of this subpackage by name."""

from __future__ import annotations

from strandloom.llm import alignment, hilbert_ann, html_text, language_id, lattice_dedup, license_scan, maxent_lm, ngram_join, packing, source_mix, token_store, warc, whitening

_MODULES = [hilbert_ann, warc, maxent_lm, lattice_dedup, language_id, html_text, packing, ngram_join, source_mix, license_scan, alignment, token_store, whitening]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
