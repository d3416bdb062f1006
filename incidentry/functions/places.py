"""Addresses, suburbs and repeatable random offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry import fixed_values as fixed
from incidentry.functions.common import as_column, strip


def suburb(address: str | Column) -> Column:
    """Upper-case suburb before ', NSW 9999'; null when the address has none."""
    found = F.upper(strip(F.regexp_extract(as_column(address), fixed.SUBURB_PATTERN, 1)))
    return F.when(found != "", found)


def postcode(address: str | Column) -> Column:
    found = F.regexp_extract(as_column(address), fixed.SUBURB_PATTERN, 2)
    return F.when(found != "", found)


def looks_like_address(location: str | Column) -> Column:
    """A digit and a comma."""
    text = F.coalesce(strip(as_column(location)), F.lit(""))
    return text.rlike("[0-9]") & text.contains(",")


def looks_like_street(location: str | Column) -> Column:
    return F.coalesce(as_column(location).rlike(fixed.STREET_ADDRESS_PATTERN), F.lit(False))


def steady_uniform(text: Column, part: int) -> Column:
    """A number in [0, 1) that depends on the text only: eight hex digits of its MD5, left or right half."""
    digits = F.substring(F.md5(text), 1 + 16 * part, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def jitter(address: str | Column, latitude: Column, metres: float = fixed.JITTER_METRES) -> tuple[Column, Column]:
    """Offset in degrees, the same for the same address."""
    address = as_column(address)
    reach_lat = metres / fixed.METRES_PER_DEGREE
    reach_lon = metres / (fixed.METRES_PER_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians(latitude))))
    known = address.isNotNull() & latitude.isNotNull()
    return (
        F.when(known, (2 * steady_uniform(address, 0) - 1) * reach_lat).otherwise(0.0),
        F.when(known, (2 * steady_uniform(address, 1) - 1) * reach_lon).otherwise(0.0),
    )
