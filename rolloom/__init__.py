"""Spark operators for the data side of rollout-based fine-tuning.

Every operator takes and returns DataFrames (or Columns); nothing is collected
to the driver and no group of unbounded size is placed in one task.
"""
