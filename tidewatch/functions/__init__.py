"""Column builders: durations, field access, aggregates and time windows."""
