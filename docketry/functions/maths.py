"""Arithmetic with the rounding and the guards that reports rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, places: int) -> Column:
    """Half-even rounding of the decimal value; for exact binary ties the same as IEEE half-even."""
    return F.bround(c, places)


def ratio(num: Column, den: Column) -> Column:
    """0.0 for an empty denominator."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def cost_usd(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Token counts by prices for a million tokens."""
    return (input_tokens * price_in + output_tokens * price_out) / F.lit(1_000_000.0)


def pro_rata(total: Column, part: Column, whole: Column) -> Column:
    """floor(total * part / whole) in whole numbers; 0 of nothing."""
    return F.when(whole > 0, F.floor(total.cast("long") * part.cast("long") / whole)).otherwise(F.lit(0)).cast("long")


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
