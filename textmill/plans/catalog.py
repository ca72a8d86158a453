"""All registered queries outside the subpackage llm."""

from __future__ import annotations

from . import answers, codes, contexts, events, projects, records, searches, texts

MODULES = [texts, searches, events, codes, projects, answers, contexts, records]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.C.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.C.sql.items()}
