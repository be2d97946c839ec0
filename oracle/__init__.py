"""Independent DuckDB SQL for the correctness oracle."""
