"""All plans by name."""

from __future__ import annotations

from . import analytics, chunks, corpus, evalsets, flows, ingest, kept, reports, retrieval, service

PLANS = {**retrieval.PLANS, **analytics.PLANS, **corpus.PLANS, **flows.PLANS, **service.PLANS, **evalsets.PLANS, **kept.PLANS, **chunks.PLANS, **reports.PLANS, **ingest.PLANS}


def queries() -> dict:
    return {name: plan for name, (plan, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
