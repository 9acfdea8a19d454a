"""Registered queries and the SQL each one is compared with."""

from plantledger.plans import (  # noqa: F401
    check_jobs, pallet_jobs, paper_jobs, production_jobs, proof_jobs, report_jobs, source_jobs, stock_jobs, stream_jobs,
)
from plantledger.plans.registry import JOBS  # noqa: F401
