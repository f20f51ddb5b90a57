"""Feature selection on large tables with Spark."""
