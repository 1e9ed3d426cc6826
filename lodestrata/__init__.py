"""Lodestrata: record logs, their repair and audit, and the queue and text work around them, on Spark."""
