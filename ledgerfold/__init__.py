"""Event-log analytics on Spark: replay, rules, read models, per-subject encryption and erasure over whole logs."""
