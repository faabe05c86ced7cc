"""Scalar expressions as Spark SQL text: timeframes, durations, date phrases, filters."""
