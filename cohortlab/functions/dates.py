"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_noted_date(noted: Column, resolved: Column, candidate: Column) -> Column:
    """A missing noted date takes ``candidate`` when the resolved date is
    missing or not before the candidate; otherwise the noted date stays."""
    return F.when(noted.isNull() & (resolved.isNull() | (resolved >= candidate)), candidate) \
            .otherwise(noted)
