"""Missing-value tokens and the coercion of text columns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Three sets of missing tokens, which differ on purpose.
READER_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
MISSING = ("", "NA", "NAN", "N/A", ".", "?", "NONE", "NULL")
SEX_MISSING = (*MISSING, "-1", "U", "UNKNOWN", "0")

FEMALE, MALE = "F", "M"


class TokenError(ValueError):
    """A column holds tokens it may not hold; the message names the first rows."""


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def without_reader_nulls(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*READER_NULLS), None).otherwise(c)


def missing_as_null(c: Column | str, extra: tuple[str, ...] = (), members: tuple[str, ...] = MISSING) -> Column:
    """The stripped token, or null if it is missing; ``extra`` tokens match exactly."""
    t = strip(c)
    gone = t.isNull() | F.upper(t).isin(*members)
    return F.when(gone | t.isin(*extra) if extra else gone, None).otherwise(t)


def sex(c: Column | str) -> Column:
    """'F', 'M', null for missing, '!' for a token of no meaning; 1 is male and 2 female."""
    t = F.upper(strip(c))
    return F.when(t.isNull() | t.isin(*SEX_MISSING), None).when(t.isin("F", "FEMALE", "2"), FEMALE).when(t.isin("M", "MALE", "1"), MALE).otherwise("!")


def plink_sex(c: Column | str) -> Column:
    """1 male, 2 female, 0 unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == MALE, 1).when(c == FEMALE, 2).otherwise(0)


def birth_year(c: Column | str) -> tuple[Column, Column]:
    """The year, truncated, null if unknown or -1; and whether the token can't be read."""
    t = missing_as_null(c)
    x = t.try_cast("double")
    bad = t.isNotNull() & (x.isNull() | F.isnan(x) | (F.abs(x) > 2147483647) | ((x < 0) & (x != -1)))
    return F.when(~bad & (x != -1), x.cast("int")), bad


def birth_date(c: Column | str) -> tuple[Column, Column]:
    """A strict ISO date, and whether the token can't be read."""
    t = missing_as_null(c)
    d = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))
    return d, t.isNotNull() & d.isNull()


def zygosity(c: Column | str) -> tuple[Column, Column]:
    """'MZ', 'DZ' or null, and whether the token can't be read."""
    t = F.upper(missing_as_null(c))
    return F.when(t.isin("MZ", "DZ"), t), t.isNotNull() & ~t.isin("MZ", "DZ")


def reference_flag(c: Column | str) -> tuple[Column, Column]:
    """True, false (also if missing), and whether the token is neither."""
    t = F.lower(missing_as_null(c))
    yes, no = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")
    return F.coalesce(t.isin(*yes), F.lit(False)), t.isNotNull() & ~t.isin(*yes, *no)


def is_plain_integer(c: Column | str) -> Column:
    """Whether the token is an integer that prints back exactly (no sign +, no leading zero, in 64 bits)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("^(0|-?[1-9][0-9]*)$") & c.try_cast("long").isNotNull()


def whole_years(start: Column, end: Column) -> Column:
    """Completed years between two dates, by month and day."""
    before = (F.month(end) < F.month(start)) | ((F.month(end) == F.month(start)) & (F.dayofmonth(end) < F.dayofmonth(start)))
    return F.year(end) - F.year(start) - before.cast("int")


def stratum(year: Column, width: int) -> Column:
    """The begin of the year's bin; null if unknown."""
    return (F.floor(year / width) * width).cast("int")


def first_rows(df: DataFrame, bad: Column, token: str, row: str = "row", most: int = 5) -> list[tuple[int, str]]:
    """The first offending rows, for a message."""
    return [(r[0], r[1]) for r in df.where(bad).select(row, token).orderBy(row).limit(most).collect()]


def require(df: DataFrame, bad: Column, token: str, what: str) -> None:
    found = first_rows(df, bad, token)
    if found:
        raise TokenError(f"{what}: " + ", ".join(f"row {r}: {t!r}" for r, t in found))
