"""How scans, sweeps, sites, patterns and groups of messages are shown, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(number: Column) -> Column:
    """Without a fraction where it is whole."""
    whole = number.cast("long")
    return F.when(number == whole, whole.cast("string")).otherwise(number.cast("string"))


def scan(pattern_number: Column, n_sweeps: Column) -> Column:
    return F.format_string("Scan (%s, %s sweeps)", pattern_number.cast("string"), n_sweeps.cast("string"))


def sweep(first_azimuth: Column, last_azimuth: Column, n_radials: Column, spacing: Column) -> Column:
    some = F.format_string("Sweep (%.1f-%.1f deg, %s radials, %s deg spacing)", first_azimuth.cast("double"), last_azimuth.cast("double"), n_radials.cast("string"), _plain(spacing))
    return F.when(n_radials > 0, some).otherwise("Sweep (no radials)")


def site(identifier: Column, city: Column, state: Column) -> Column:
    return F.format_string("%s (%s, %s)", identifier, city, state)


def pattern(number: Column, description: Column) -> Column:
    """description: "Unknown" where there is none."""
    return F.when(description == "Unknown", F.format_string("VCP %s", number.cast("string"))).otherwise(F.format_string("VCP %s (%s)", number.cast("string"), description))


def message_group(message_type: Column, count: Column, elevation: Column) -> Column:
    """A run of messages, with its elevation where it has one."""
    return F.when(elevation.isNull(), F.format_string("%s x %s", message_type, count.cast("string"))).otherwise(
        F.format_string("%s x %s (elevation %s)", message_type, count.cast("string"), elevation.cast("string"))
    )


def text(data: Column, lossy: bool = False) -> Column:
    """Bytes as UTF-8: null where they are none, or with replacement characters."""
    return F.make_valid_utf8(data.cast("string")) if lossy else F.try_validate_utf8(data.cast("string"))


def trimmed(data: Column) -> Column:
    """A text field without the NULs and blanks that fill it up; null where it is no UTF-8."""
    return F.trim(F.regexp_replace(text(data), "\\x00+$", ""))


def hex_dump(data: Column, width: int = 16) -> Column:
    """Lines of so many bytes in hex, of all the bytes."""
    n = F.ceil(F.length(data) / width).cast("int")
    lines = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 0, F.transform(lines, lambda k: F.hex(F.substring(data, k * width + 1, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def hex_lines(rows: DataFrame, data: str, width: int = 16) -> DataFrame:
    """A row per line of the hex dump of each row's bytes, with line (from 0) and dump."""
    n = F.ceil(F.length(data) / width).cast("int")
    lines = rows.where(n > 0).withColumn("line", F.explode(F.sequence(F.lit(0), n - 1)))
    return lines.withColumn("dump", F.hex(F.substring(F.col(data), F.col("line") * width + 1, F.lit(width))))
