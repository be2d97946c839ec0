"""Column expressions: encoders, exposure periods and durations, statistics."""
