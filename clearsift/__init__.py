"""Entitlement-aware retrieval and audit analytics as PySpark DataFrame jobs."""
