"""Sighting, presence and reporting analytics on Spark DataFrames and streams."""

from .params import GapRules, JobParams

__all__ = ["GapRules", "JobParams"]
