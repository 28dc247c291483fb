"""Outcome-distribution analytics on Spark: one row per episode, never collapsed early."""

from episodeframe.frame import Episodes
from episodeframe.schema import EPISODE, TRAJECTORY

__all__ = ["EPISODE", "Episodes", "TRAJECTORY"]
