"""Column expressions around the methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaling(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature in one pass; a constant one has deviation 1."""
    row = df.agg(*(f(F.col(f"`{c}`").cast("double")) for c in features for f in (F.avg, F.stddev_pop))).head()
    return {c: (float(row[2 * i]), float(row[2 * i + 1]) or 1.0) for i, c in enumerate(features)}


def standardized(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Features less their mean, by their deviation; other columns as they are."""
    return df.withColumns({c: (F.col(f"`{c}`").cast("double") - mean) / deviation for c, (mean, deviation) in scale.items()})


def membership_entropy(membership: str | Column) -> Column:
    """-sum p ln p of an array of memberships."""
    return F.aggregate(membership, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def effective_units(membership: str | Column) -> Column:
    """The number of units that equal memberships of that entropy would share."""
    return F.exp(membership_entropy(membership))
