"""Scalar helpers built from native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segstats.constants import SUFFIXES, VALID_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_extension(path: Column) -> Column:
    """First supported extension the lower-cased path ends with, else null."""
    low = F.lower(path)
    return F.coalesce(*[F.when(low.endswith(ext), F.lit(ext)) for ext in VALID_EXTENSIONS])


def is_generated(name: Column) -> Column:
    """True for files the pipelines write themselves (any output suffix)."""
    hit = F.lit(False)
    for suffix in SUFFIXES.values():
        hit = hit | name.endswith(suffix)
    return hit


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def round_scaled(value: Column, places: int) -> Column:
    """Array-style rounding: scale, round half to even, scale back."""
    return F.rint(value * F.lit(float(10**places))) / F.lit(float(10**places))


def round_exact(value: Column, places: int) -> Column:
    """Round the exact binary value, so only true ties go to the even digit.

    The scaling error is recovered by splitting the value in two exact halves.
    """
    scale = F.lit(float(10**places))
    product = value * scale
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    error = (high * scale - product) + (value - high) * scale
    low = F.floor(product)
    tie = product - low == 0.5
    nearest = F.when(tie & (error > 0), low + 1).when(tie & (error < 0), low).otherwise(F.rint(product))
    return nearest.cast("double") / scale


def clean_nan(value: Column) -> Column:
    """NaN becomes null, the engine's only missing value."""
    return F.when(~F.isnan(value), value)


def fixed(value: Column, places: int) -> Column:
    """Fixed-decimal text of the exactly rounded value."""
    return F.format_string(f"%.{places}f", round_exact(value, places))


def gray_level(channels: Column, blue_first: bool = True) -> Column:
    """Gray level of a pixel given as an array of channel values.

    One channel stays, gray with alpha keeps gray, colour is weighted and alpha dropped.
    """
    r, g, b = (2, 1, 0) if blue_first else (0, 1, 2)
    n = F.size(channels)
    luma = 0.299 * channels[r] + 0.587 * channels[g] + 0.114 * channels[b]
    return F.when(n <= 2, channels[0].cast("double")).otherwise(luma)


def to_bits(value: Column, bits_in: int, bits_out: int) -> Column:
    """Integer intensity in another depth: drop low bits, or spread over the wider range."""
    if bits_in > bits_out:
        return F.shiftright(value, bits_in - bits_out)
    if bits_in < bits_out:
        return value * ((2**bits_out - 1) // (2**bits_in - 1))
    return value


def float_to_bits(value: Column, low: Column, high: Column, bits: int = 8) -> Column:
    """Float intensity in bits: values in [0, 1] are scaled, others stretched from [low, high].

    An image of one value outside [0, 1] cannot be stretched; it keeps that value, as far as the bits reach.
    """
    top = 2**bits - 1
    unit = (low >= 0) & (high <= 1)
    scaled = F.when(unit, value).otherwise(F.try_divide(value - low, high - low))
    # fixed value: rounds halves down, as the public image library does
    wide = F.floor(scaled * top + 0.499999999)
    constant = F.floor(F.greatest(F.lit(0.0), F.least(value, F.lit(float(top)))))
    return F.when(~unit & (low == high), constant).otherwise(F.coalesce(wide, F.lit(0))).cast("int")
