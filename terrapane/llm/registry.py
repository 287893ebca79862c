"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from terrapane.llm import decontam, language, pieces, pii, quality, secrets, sharding, simhash, token_store, token_tree

MODULES = (token_tree, sharding, language, pii, decontam, secrets, pieces, token_store, simhash, quality)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
