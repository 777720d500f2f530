"""Versioned document collections on Spark: spans, chunks, retrieval, evidence rules and change tracking."""
