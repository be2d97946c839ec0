"""Sources and sinks: parquet tables, proxy views over the test tables."""
