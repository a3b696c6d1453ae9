"""Plain Python helpers for work on single rows; nothing here knows Spark."""
