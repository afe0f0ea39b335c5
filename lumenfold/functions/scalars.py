"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least positive double; a floor under logarithms.
TINY = 5e-324


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def numeric(text: Column, fallback: float | None = None) -> Column:
    """A number cell: blank, unreadable and non-finite text give fallback.

    Only decimal notation is read; Spark's own cast would take "NaN" or "1d".
    """
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), finite(trimmed.try_cast("double")))
    return number if fallback is None else F.coalesce(number, F.lit(float(fallback)))


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + 0.5)


def normalize(value: Column, low: Column, high: Column) -> Column:
    """Where value lies between low and high, within 0 and 1; 0.5 if they are equal."""
    return F.when(high == low, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0)))))


def clock(seconds: Column, longest: float) -> Column:
    """mm:ss, within 0 and longest."""
    whole = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(longest)), seconds)))
    return F.concat(F.lpad(F.floor(whole / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def metric_text(value: Column, decimals: int = 1) -> Column:
    """A metric to show: a dash if missing; ".0" is left off only with one decimal."""
    text = F.format_string(f"%.{decimals}f", finite(value))
    text = F.regexp_replace(text, r"\.0$", "") if decimals == 1 else text
    return F.coalesce(F.when(finite(value).isNotNull(), text), F.lit("—"))


def signed_metric_text(value: Column, decimals: int = 1) -> Column:
    """As metric_text, with + or the minus sign U+2212 in front."""
    text = metric_text(F.abs(value), decimals)
    return F.when(finite(value).isNull(), "—").when(value > 0, F.concat(F.lit("+"), text)).when(value < 0, F.concat(F.lit("−"), text)).otherwise(text)


def decibels(power: Column, factor: float = 10.0) -> Column:
    return factor * F.log10(F.greatest(power, F.lit(TINY)))


def power_of_two(value: Column) -> Column:
    """The highest power of two up to value, at least 1."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), value)))).cast("long")


def sample_evenly(values: Column, most: int) -> Column:
    """At most `most` values of an array, evenly spaced, both ends among them."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: half_up(i * (n - 1) / (most - 1)).cast("int"))
    return F.when(n <= most, values).otherwise(F.transform(at, lambda i: F.get(values, i)))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the UTF-16 code units of text below U+10000, as 8 hexadecimal digits."""
    # fixed values: offset basis and prime of the 32-bit variant
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    turn = lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), turn)), 8, "0"))



def number_text(value: Column, digits: int = 2, suffix: str = "") -> Column:
    """A number with so many decimals and a suffix; a dash if it is missing."""
    return F.coalesce(F.when(finite(value).isNotNull(), F.concat(F.format_string(f"%.{digits}f", finite(value)), F.lit(suffix))), F.lit("—"))


def duration_text(seconds: Column) -> Column:
    """mm:ss of rounded seconds, missing as 0."""
    whole = F.greatest(F.lit(0), half_up(F.coalesce(finite(seconds), F.lit(0.0))))
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def html_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out
