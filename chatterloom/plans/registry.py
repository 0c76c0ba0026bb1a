"""All queries of the core: name to callable (spark, sf_dir) -> DataFrame, and name to SQL."""

from __future__ import annotations

from chatterloom.plans import clusters, corpus, dynamics, evaluation, modelling, training

MODULES = (training, dynamics, evaluation, corpus, clusters, modelling)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
