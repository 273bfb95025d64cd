"""Loads every module that registers jobs."""

import importlib

MODULES = (
    "jobs_gazetteer",
    "jobs_parse",
    "jobs_retrieval",
    "jobs_evaluate",
    "jobs_orders",
    "jobs_learn",
    "jobs_corpus",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"waymark.plans.{name}")


load()
