"""Relational operators of the study: joins, aggregations, matching, tests."""
