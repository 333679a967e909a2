"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import ann, decontamination, html_extraction, language_id, line_dedup, mixing, ngram_join, quality, resampling, secret_scan, substring_dedup, toxicity, whitening

MODULES = (mixing, decontamination, toxicity, line_dedup, language_id, ann, ngram_join, secret_scan, substring_dedup, quality, html_extraction, whitening, resampling)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
