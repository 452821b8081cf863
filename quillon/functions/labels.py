"""Display values as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.schemas import STAGE_LABELS, STAGES

# Wording.
NO_PLACE, NONE, YES, NO_WEBSITE = "Sin datos de ubicación", "—", "Sí", "Sin web"
NEVER, NOW = "Sin analizar", "Hace instantes"


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def location(*parts: Column) -> Column:
    return F.coalesce(_given(F.concat_ws(" · ", *map(_given, parts))), F.lit(NO_PLACE))


def rating(value: Column, reviews: Column) -> Column:
    """Null and 0 have none."""
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, F.concat(F.format_string("%.1f", value), F.lit(" ("), F.coalesce(reviews, F.lit(0)).cast("string"), F.lit(")"))).otherwise(NONE)


def progress(current: Column, total: Column) -> Column:
    return F.concat(current.cast("string"), F.lit("/"), F.coalesce(F.nullif(total, F.lit(0)).cast("string"), F.lit("?")))


def website(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) != "", YES).otherwise(NO_WEBSITE)


def stage_label(stage: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(STAGES, STAGE_LABELS, strict=True) for x in pair]), stage)


def relative_age(at: Column, now: Column) -> Column:
    """Whole hours, and days rounded from these."""
    hours = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)).cast("long")
    days = F.round(hours / F.lit(24.0)).cast("long")
    return (
        F.when(at.isNull(), NEVER).when(hours < 1, NOW).when(hours < 24, F.concat(F.lit("Hace "), hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.lit("Hace "), days.cast("string"), F.lit("d")))
    )


def grouped(value: Column, decimals: int = 0) -> Column:
    """Thousands by point and decimals by comma; numbers under 10,000 stay whole, as Spanish writes them."""
    text = F.translate(F.format_number(value, decimals), ",.", ".,")
    return F.when(F.abs(value) < 10_000, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)


def dollars(value: Column) -> Column:
    """Two to four decimals."""
    cents = F.regexp_replace(F.regexp_extract(F.format_number(value, 4), r"\.(\d{4})$", 1), "0{1,2}$", "")
    whole = F.regexp_replace(grouped(F.round(value, 4), 4), r",\d{4}$", "")
    return F.concat(whole, F.lit(","), cents, F.lit("\u00a0US$"))


def day(at: Column) -> Column:
    return F.date_format(at, "d/M/yyyy")


def euros(value: Column) -> Column:
    return F.concat(grouped(value), F.lit("\u00a0€"))
