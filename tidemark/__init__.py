"""Temporal event analytics on Spark: runs, intervals, as-of joins, folds, event logs and questions."""
