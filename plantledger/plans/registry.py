"""Registration of queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from plantledger.plans.views import query

Run = Callable[[SparkSession, str], DataFrame]


class Job(NamedTuple):
    run: Run
    sql: str | None


JOBS: dict[str, Job] = {}


def job(sql: str | None = None, *views: str) -> Callable[[Run], Run]:
    """Register a query under its function name; ``views`` are the stand-ins its SQL reads."""
    def register(run: Run) -> Run:
        JOBS[run.__name__] = Job(run, query(sql, *views) if sql else None)
        return run
    return register
