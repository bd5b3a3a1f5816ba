"""Bin and grid membership as column expressions.

Edges are ``i * (1 / n)`` in double arithmetic with the last edge exactly 1.0.
A first guess from floor / ceil is corrected against the true edges, so a score
that equals an edge lands where a direct comparison would put it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def edge(i: Column, n: int) -> Column:
    return F.when(i == n, F.lit(1.0)).otherwise(i * F.lit(1.0 / n))


def upper_closed_bin(c: Column, n: int = 10) -> Column:
    """Index of the bin (lo, hi] holding ``c``; null outside (0, 1]."""
    guess = F.ceil(c * n).cast("int")
    fixed = (
        F.when(c > edge(guess, n), guess)
        .when(c <= edge(guess - 1, n), guess - 2)
        .otherwise(guess - 1)
    )
    return F.when((c > 0.0) & (c <= 1.0), fixed)


def lower_closed_bin(c: Column, n: int = 10) -> Column:
    """Index of the bin [lo, hi) holding ``c``, the last bin closed; null outside [0, 1]."""
    guess = F.least(F.floor(c * n).cast("int"), F.lit(n - 1))
    fixed = (
        F.when(c < edge(guess, n), guess - 1)
        .when((c >= edge(guess + 1, n)) & (guess + 1 < n), guess + 1)
        .otherwise(guess)
    )
    return F.when((c >= 0.0) & (c <= 1.0), fixed)


def grid_index(c: Column, steps: int = 1000) -> Column:
    """Largest i in 0..steps with ``edge(i) <= c``; -1 when c is below every edge."""
    guess = F.least(F.greatest(F.floor(c * steps), F.lit(-1)), F.lit(steps)).cast("int")
    return (
        F.when((guess < steps) & (edge(guess + 1, steps) <= c), guess + 1)
        .when((guess >= 0) & (edge(guess, steps) > c), guess - 1)
        .otherwise(guess)
    )


def linear_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin over [low, high], last bin closed, single value in bin 0."""
    width = (high - low) / F.lit(float(bins))
    raw = F.floor((value - low) / F.when(width > 0, width).otherwise(F.lit(1.0)))
    return F.when(
        (value >= low) & (value <= high), F.least(raw, F.lit(bins - 1)).cast("int")
    )
