"""Failures that stop a job before it writes anything."""

from __future__ import annotations


class DataQualityError(RuntimeError):
    """Input data or an intermediate table breaks an expectation."""


class SmokeGateError(DataQualityError):
    """A baseline model misses the quality floor or the time limit."""


class ConvergenceError(RuntimeError):
    """An iteration passed its limit before it came to rest."""
