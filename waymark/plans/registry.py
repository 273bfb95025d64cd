"""Every job by name: how Spark runs it and what DuckDB must agree with."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from waymark.sources.fixtures import duckdb_views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Job:
    name: str
    ids: tuple[str, ...]
    run: Run
    oracle: str | None


JOBS: dict[str, Job] = {}


def statement(body: str) -> str:
    """A DuckDB statement with the derived views in front of ``body``."""
    body = body.strip()
    rest = body[4:].lstrip() if body.lower().startswith("with ") else None
    tail = f",\n{rest}" if rest is not None else f"\n{body}"
    return f"with recursive {duckdb_views()}{tail}"


def job(name: str, ids: str, oracle: str | None = None):
    def register(run: Run) -> Run:
        if name in JOBS:
            raise ValueError(f"job {name} registered twice")
        JOBS[name] = Job(name, tuple(ids.split()), run, statement(oracle) if oracle else None)
        return run

    return register
