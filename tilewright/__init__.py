"""Probe-panel analytics and corpus preparation as Spark jobs."""
