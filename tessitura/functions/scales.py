"""Frequency scales, companding and decisions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(z: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), z / 2595) - 1)


def hz_to_mel_slaney(f: Column) -> Column:
    """Linear below 1 kHz, logarithmic above."""
    return F.when(f < 1000, f * 3 / 200).otherwise(15 + F.ln(f / 1000) * 27 / math.log(6.4))


def hz_to_bark(f: Column) -> Column:
    return 6 * F.asinh(f / 600)


def bark_to_hz(z: Column) -> Column:
    return 600 * F.sinh(z / 6)


def mu_law_to_linear(code: Column, scale: float = 4004.189931) -> Column:
    """Linear sample of an 8-bit mu-law code."""
    b = 255 - code.cast("int")
    exponent, mantissa = F.floor(b % 128 / 16), b % 16
    size = (2 * mantissa + 33) * F.pow(F.lit(2.0), exponent) - 33
    return F.when(b >= 128, -size).otherwise(size) / scale
