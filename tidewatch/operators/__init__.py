"""Relational operators: scenarios, gates, triage, graph features, drift and metrics."""
