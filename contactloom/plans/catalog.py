"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from contactloom.plans import contact_queries, dataset_queries, heavy_key_queries, pipeline_queries
from contactloom.plans.registry import Query

MODULES = (heavy_key_queries, contact_queries, dataset_queries, pipeline_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.REGISTRY.queries.items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.sql.items()}
