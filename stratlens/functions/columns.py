"""Scalar building blocks as native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def product_prefix(spread: Column | str) -> Column:
    """Upper-case letters of the first leg; a leg without letters keeps its first two characters."""
    leg = F.split_part(F.coalesce(_col(spread), F.lit("nan")), F.lit("&"), F.lit(1))
    return F.coalesce(F.nullif(F.upper(_letters(leg)), F.lit("")), F.substring(leg, 1, 2))


def spread_product(spread: Column | str) -> Column:
    """Lower-case letters of the first leg; a leg without letters keeps its first character."""
    leg = F.split_part(F.coalesce(_col(spread), F.lit("nan")), F.lit("&"), F.lit(1))
    return F.lower(F.coalesce(F.nullif(_letters(leg), F.lit("")), F.substring(leg, 1, 1)))


def spread_pair_folder(spread: Column | str) -> Column:
    """``A2105&B2102`` gives ``A&B``; a name with a single leg stays as it is."""
    name = _col(spread)
    first = F.upper(_letters(F.split_part(name, F.lit("&"), F.lit(1))))
    second = F.upper(_letters(F.split_part(name, F.lit("&"), F.lit(2))))
    return F.when(F.contains(name, F.lit("&")), F.concat(first, F.lit("&"), second)).otherwise(name)


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL, the engine's only notion of missing."""
    number = _col(value)
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number)


def return_or_zero(ret: Column | str = "daily_pnl_pct") -> Column:
    return F.coalesce(_col(ret).cast("double"), F.lit(0.0))


def is_active(pnl: Column | str = "daily_pnl") -> Column:
    """True for any value but zero; a missing value counts as active."""
    return ~_col(pnl).eqNullSafe(F.lit(0))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    bottom = _col(denominator)
    return _col(numerator) / F.when(bottom != 0, bottom)


def clip01(value: Column | str) -> Column:
    return F.greatest(F.least(_col(value), F.lit(1.0)), F.lit(0.0))


def is_gain(value: Column | str) -> Column:
    return F.coalesce(_col(value) >= 0, F.lit(False))


def month_label(date: Column | str = "date") -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def side(text: Column | str) -> Column:
    """Direction and offset are compared upper-cased; a missing one matches nothing."""
    return F.upper(F.coalesce(_col(text), F.lit("nan")))


def beyond_entry(z: Column | str, entry_z: float) -> Column:
    return F.abs(_col(z)) >= F.lit(float(entry_z))


def lenient_double(text: Column | str) -> Column:
    """A number where the text reads as one, else NULL (Spark alone would also take ``1.0d``)."""
    raw = _col(text).cast("string")
    return F.when(F.lower(raw).rlike(NUMBER), F.trim(raw).try_cast("double"))


def lenient_timestamp(text: Column | str) -> Column:
    """Wall-clock time from ``yyyy-MM-dd``, ``yyyy/MM/dd`` or ``yyyyMMdd``, each with optional time."""
    raw = F.trim(_col(text).cast("string"))
    dashed = F.regexp_replace(raw, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    dashed = F.regexp_replace(dashed, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    return dashed.try_cast("timestamp_ntz")


def strict_timestamp(text: Column | str) -> Column:
    """As ``lenient_timestamp``, but unreadable text fails the job instead of turning into NULL."""
    raw = _col(text)
    parsed = lenient_timestamp(raw)
    problem = F.raise_error(F.concat(F.lit("not a date or time: "), raw.cast("string")))
    return F.when(raw.isNotNull() & parsed.isNull(), problem.cast("timestamp_ntz")).otherwise(parsed)


def named_or_at(columns: Sequence[str], name: str, place: int) -> str:
    """The column of that name, else the one in that place."""
    return name if name in columns else columns[place]
