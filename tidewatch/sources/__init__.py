"""Typed scans, sinks, file manifests and the adapter views over the test tables."""
