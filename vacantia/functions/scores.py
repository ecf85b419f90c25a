"""Numbers: rounding, set similarity and the weighted scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import rules


def rounded(value: Column, digits: int = 4) -> Column:
    """Round half to even on the decimal text, so that summation noise does not change a digit."""
    return F.bround(value.cast("decimal(20,10)"), digits).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when both sets are empty."""
    return jaccard_of_sizes(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_of_sizes(shared: Column, union: Column) -> Column:
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def same_label(a: Column, b: Column) -> Column:
    """Equality in which null and '' are one value."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def hybrid(embedding: Column, skills: Column, same_category: Column, same_seniority: Column) -> Column:
    return (
        F.lit(rules.WEIGHT_EMBEDDING) * embedding
        + F.lit(rules.WEIGHT_SKILLS) * skills
        + F.lit(rules.WEIGHT_CATEGORY) * same_category.cast("double")
        + F.lit(rules.WEIGHT_SENIORITY) * same_seniority.cast("double")
    )


def overlap_share(query_words: Column, text_words: Column) -> Column:
    """Share of the distinct query words found in the text; 0 when either side has none."""
    both = (F.size(query_words) > 0) & (F.size(text_words) > 0)
    return F.when(both, F.size(F.array_intersect(query_words, text_words)) / F.size(query_words)).otherwise(F.lit(0.0))
