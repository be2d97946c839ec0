"""Concept sets (C1, C2): registry codes expanded through the pre-computed
ancestor closure, then patched and cleaned.

The study looked codes up one at a time, collecting each list to the driver
and splicing it into SQL text. Here all registry codes for all risk factors
are expanded in one join, and the result stays a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_position


def concept_descendants(registry: DataFrame, concept: DataFrame, ancestor: DataFrame,
                        vocabulary: str = "SNOMED") -> DataFrame:
    """For every (risk_factor, concept_code) registry row, all descendants
    in the closure (distance 0 included). Only the ancestor side is restricted
    to ``vocabulary``; codes are compared as strings (never as numbers)."""
    anc = concept.filter(F.col("vocabulary_id") == vocabulary).select(
        F.col("concept_id").alias("anc_id"),
        F.col("concept_code").alias("ancestor_snomed_code"),
        F.col("concept_name").alias("ancestor_concept_name"))
    desc = concept.select(
        F.col("concept_id").alias("descendant_concept_id"),
        F.col("concept_code").alias("descendant_snomed_code"),
        F.col("concept_name").alias("descendant_concept_name"))
    reg = registry.select("risk_factor", F.col("concept_code").alias("ancestor_snomed_code"))
    a = reg.join(anc, "ancestor_snomed_code")
    a = a.join(ancestor.select(F.col("ancestor_concept_id").alias("anc_id"),
                               "descendant_concept_id", "min_levels_of_separation"), "anc_id")
    a = a.join(desc, "descendant_concept_id")
    return a.select("risk_factor", "ancestor_snomed_code", "ancestor_concept_name",
                    "descendant_snomed_code", "descendant_concept_name",
                    "min_levels_of_separation")


def ordered_descendants(descendants: DataFrame) -> DataFrame:
    """``concept_descendants`` in the study's order, by closeness, then name, for each
    ancestor code: ``position`` among all rows by (factor, ancestor, closeness, name, code) and
    ``place`` within its (factor, ancestor), which starts at 1."""
    group = ["risk_factor", "ancestor_snomed_code"]
    order = [*group, "min_levels_of_separation", "descendant_concept_name", "descendant_snomed_code", "ancestor_concept_name"]
    rows = with_position(descendants, order)
    first = rows.groupBy(*group).agg(F.min("position").alias("_first"))
    return rows.join(first, group).withColumn("place", F.col("position") - F.col("_first") + 1).drop("_first")


def risk_code_set(descendants: DataFrame, patch: DataFrame | None = None,
                  excluded_prefix: str = "OMOP") -> DataFrame:
    """Distinct (risk_factor, code), minus the factor's patch codes, minus
    codes that start with ``excluded_prefix``."""
    codes = descendants.select("risk_factor", F.col("descendant_snomed_code").alias("code"))
    codes = codes.filter(~F.col("code").startswith(excluded_prefix)).distinct()
    if patch is not None:
        p = patch.select("risk_factor", F.col("concept_code").alias("code"))
        codes = codes.join(p, ["risk_factor", "code"], "left_anti")
    return codes
