"""Operators with state over unbounded tables."""
