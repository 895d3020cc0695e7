"""All registered queries."""

from . import q_ingest, q_jobs, q_reporting  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
