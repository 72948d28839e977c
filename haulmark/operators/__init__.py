"""Exporting, validating, loading, checking, log analytics, run state and dependency tables."""
