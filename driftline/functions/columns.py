"""Small column expressions shared by the operators. All are built-ins, evaluated in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "no value" in an export, besides the empty field.
NA_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Fixed value: the number an export writes for a missing measurement.
MISSING_MARKER = -200.0

NUMBER = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?"
# A number, a no-value token, or blank: everything a measurement field may hold.
FIELD_PATTERN = rf"^\s*(?:{NUMBER}|{'|'.join(re.escape(token) for token in NA_TOKENS)}|)\s*$"
DATE_PATTERN = r"^\d{1,2}/\d{1,2}/\d{4}$"
TIME_PATTERN = r"^\d{1,2}\.\d{1,2}\.[0-5]?\d$"


def q(name: str) -> Column:
    """Column by its exact name, dots and brackets included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_for_nan(name: str) -> Column:
    """The column as a double with NaN as NULL, so it is never compared or added as a value."""
    return F.nanvl(q(name).cast("double"), F.lit(None).cast("double")).alias(name)


def total(columns: list[Column]) -> Column:
    """Sum of columns, added from the left."""
    return reduce(lambda a, b: a + b, columns)


def text_or_null(field: Column) -> Column:
    """Trimmed text; blank fields and the no-value tokens become NULL."""
    trimmed = F.trim(field)
    return F.when((trimmed != "") & ~trimmed.isin(*NA_TOKENS), trimmed)


def valid_field(text: Column) -> Column:
    """True for an absent value or a number with a decimal comma or point."""
    return F.coalesce(text.rlike(FIELD_PATTERN), F.lit(True))


def measurement(text: Column) -> Column:
    """The number in a valid field; blank, no-value tokens and the marker become NULL."""
    value = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return F.nullif(F.nanvl(value, F.lit(None).cast("double")), F.lit(MISSING_MARKER))


def day_first_timestamp(date: Column, time: Column) -> Column:
    """``d/m/yyyy`` and ``H.M.S`` to a wall-clock timestamp, NULL when not valid.

    Built from its parts, so the session's time zone has no influence.
    """
    d, t = F.trim(date), F.trim(time)
    part = lambda text, mark, i: F.split_part(text, F.lit(mark), F.lit(i)).try_cast("int")
    stamp = F.try_make_timestamp_ntz(
        part(d, "/", 3), part(d, "/", 2), part(d, "/", 1),
        part(t, ".", 1), part(t, ".", 2), part(t, ".", 3).cast("decimal(16,6)"),
    )
    return F.when(d.rlike(DATE_PATTERN) & t.rlike(TIME_PATTERN), stamp)


def epoch_second(ts: Column, kind: T.DataType) -> Column:
    """Whole seconds in the order of the timestamps.

    Of an instant, those since 1970-01-01 UTC, as a wall clock goes back when
    daylight saving ends; of a timestamp without zone, those of its wall clock.
    """
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(ts)
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + clock.cast("long")


def epoch_day(ts: Column, kind: T.DataType) -> Column:
    """Number of the 86,400 seconds that ``epoch_second`` lies in."""
    return F.floor(epoch_second(ts, kind) / 86400).cast("long")


def iso(ts: Column) -> Column:
    """ISO-8601 text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def finite(value: Column) -> Column:
    """True for a number, false for NULL, NaN and the infinities."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def finite_or_null(value: Column) -> Column:
    return F.when(finite(value), value)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
