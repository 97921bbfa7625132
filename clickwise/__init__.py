"""clickwise — Spark-native event, order and operations analytics.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL built-ins, so the same code runs on batch tables and, where the
docstring says so, on Structured Streaming DataFrames.
"""

__version__ = "0.1.0"
