"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}
