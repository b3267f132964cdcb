"""All queries of the core, collected from the modules that define them."""

from __future__ import annotations

from hopwarden.plans import feature_queries, general, graph_queries, landing_queries, model_queries, path_queries, verdict_queries
from hopwarden.plans.registry import Registry

MODULES = (general, path_queries, graph_queries, feature_queries, verdict_queries, model_queries, landing_queries)


def registry() -> Registry:
    found = Registry()
    for module in MODULES:
        found.include(module.R)
    return found
