"""Readers and writers (Spark data sources only)."""
