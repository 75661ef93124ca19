"""Driftline: replication and reconciliation of keyed tables as Spark jobs."""
