"""Scalar column functions: roundings, path tests and sub-scores."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schemas import CODE_LANGUAGES, HIGHER


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: Column | str, digits: int = 2) -> Column:
    """Nearest multiple of 10**-digits of the binary value, halves upwards."""
    scale = float(10**digits)
    # floor gives a long; the division by a double makes it one again.
    return F.floor(_col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_half_up_py(x: float, digits: int = 2) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def one_decimal(x: float) -> str:
    """One decimal of the exact binary value, ties away from zero."""
    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def is_external(path: Column | str) -> Column:
    """Whether a module path lies outside the project: packages, built-ins, and bare names without a slash."""
    p = _col(path)
    return p.contains("node_modules") | p.startswith("node:") | ~p.contains("/")


def is_code_language(name: Column | str) -> Column:
    return _col(name).isin(*CODE_LANGUAGES)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def lower_better(value: Column, good: Column, bad: Column) -> Column:
    """10 at ``good`` or below, 0 at ``bad`` or above, linear between, two decimals."""
    share = clamp01((value - good) / F.nullif(bad - good, F.lit(0.0)))
    return F.when(good == bad, F.when(value <= good, 10.0).otherwise(0.0)).otherwise(F.floor((1 - share) * 1000.0 + 0.5) / 100.0)


def higher_better(value: Column, good: Column, bad: Column) -> Column:
    share = clamp01((value - bad) / F.nullif(good - bad, F.lit(0.0)))
    return F.when(good == bad, F.when(value >= good, 10.0).otherwise(0.0)).otherwise(F.floor(share * 1000.0 + 0.5) / 100.0)


def sub_score(value: Column | str, good: Column | str, bad: Column | str, direction: Column | str) -> Column:
    v, g, b = _col(value), _col(good), _col(bad)
    return F.when(_col(direction) == HIGHER, higher_better(v, g, b)).otherwise(lower_better(v, g, b))
