"""Trip-specific column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripledger.contract import PAYMENT_LABELS, UNKNOWN_PAYMENT

REVENUE_VARIANTS = ("fare", "fare_tip_tolls")


def payment_label(code: Column) -> Column:
    """Label of a payment code; unlisted codes and NULL are unknown."""
    label = None
    for known, name in PAYMENT_LABELS.items():
        matches = code == known
        label = F.when(matches, name) if label is None else label.when(matches, name)
    return label.otherwise(UNKNOWN_PAYMENT)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Elapsed minutes with fractions kept; negative when the end precedes the start.

    Takes the difference of zone-free timestamps as an interval, which no clock change of the
    session time zone affects; TIMESTAMPDIFF would go through zoned timestamps.
    """
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / F.lit(60.0)


def revenue(variant: str = "fare") -> Column:
    """Revenue of a trip: the fare alone, or fare plus tip plus tolls."""
    if variant == "fare":
        return F.col("fare_amount")
    if variant == "fare_tip_tolls":
        return F.col("fare_amount") + F.col("tip_amount") + F.col("tolls_amount")
    raise ValueError(f"unknown revenue variant {variant!r}; use one of {REVENUE_VARIANTS}")
