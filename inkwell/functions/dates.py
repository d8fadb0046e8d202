"""Timestamps: tolerant parsing to UTC and calendar parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from inkwell.functions.text import strip

# Accepted formats besides ISO 8601.
FORMATS = (
    "MMMM d, yyyy h:mm a",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d MMM yyyy HH:mm:ss Z",
)
HAS_ZONE = r"(?i)(Z|UTC|GMT|[+-]\d{2}:?\d{2})$"


def parse_ts(text: Column, formats: Sequence[str] = FORMATS, strict: bool = False) -> Column:
    """Mixed formats to a zone-free UTC timestamp; text without a zone is UTC.

    Unreadable text becomes NULL, or fails the job when ``strict``.
    """
    raw = F.regexp_replace(strip(text), r"^[A-Za-z]{3}, (?=\d)", "")
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw)
    dated = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(iso, F.lit(" 00:00:00"))).otherwise(iso)
    zoned = F.when(dated.rlike(HAS_ZONE), dated).otherwise(F.concat(dated, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    tries = [F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz"))]
    for fmt in formats:
        parsed = F.try_to_timestamp(F.when(iso.isNull(), raw), F.lit(fmt))
        if fmt.endswith("Z"):
            tries.append(
                F.convert_timezone(F.current_timezone(), F.lit("UTC"), parsed.cast("timestamp_ntz"))
            )
        else:
            tries.append(parsed.cast("timestamp_ntz"))
    found = F.coalesce(*tries)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unreadable timestamp: "), text))
        return F.when(found.isNull() & text.isNotNull(), bad.cast("timestamp_ntz")).otherwise(found)
    return found


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "date": F.to_date(ts),
        "month": month_of(ts),
        "hour": F.hour(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "year": F.year(ts),
    }
