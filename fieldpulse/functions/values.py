"""Column helpers: missing values, lenient casts, epoch arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.schemas import MISSING_WORDS

DAY = 86400
_SERIAL_EPOCH_DAYS = 25569  # 1899-12-30 to 1970-01-01
_BLANK = r"[\s\p{Z}\x{FEFF}]+"  # every kind of white space, no-break spaces too
_BLANKS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# ---- fixed values: spellings of a moment beside ISO ones, each with optional time, and how such a text starts
MOMENT_DATES = {r"^\d{1,2}\.": "d.M.yyyy", r"^\d{1,2}/": "M/d/yyyy", r"^\d{3,}/": "yyyy/M/d"}
MOMENT_TIMES = {r":.*:": " H:mm:ss", r":": " H:mm", r"": ""}
# ---- end of fixed values
_SERIAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def finite_frame(df: DataFrame) -> DataFrame:
    """``finite`` on every floating column: the only kind of missing inside the library is NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([finite(c).alias(c) if c in floats else F.col(c) for c in df.columns]) if floats else df


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row; NaN and infinities are written as null."""
    clean = finite_frame(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("json"))


def trimmed(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(col(c).cast("string"), F.lit(_BLANKS))


def clean_string(c: Column | str) -> Column:
    """Trim; empty text and spelled-out missing values become NULL."""
    text = trimmed(c)
    return F.when(text.isin(MISSING_WORDS), None).otherwise(text)


def to_number(c: Column | str) -> Column:
    """Lenient numeric cast: text that is no finite number becomes NULL."""
    return finite(col(c).try_cast("double"))


def first_number(c: Column | str) -> Column:
    """The first decimal number written anywhere in a text, with its exponent; of a numeric column the number itself.

    Numbers are written so that the text says the same: doubles below 1e-3 and from 1e7 on carry an exponent.
    """
    found = F.regexp_extract(col(c).cast("string"), r"(-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)", 1)
    return found.try_cast("double")


def parse_moment(c: Column | str) -> Column:
    """Timestamp from text or from a spreadsheet day number; anything else becomes NULL.

    Besides ISO spellings, day.month.year, month/day/year and year/month/day are read, with or without a time. Years a
    nanosecond clock cannot hold (before 1678, after 2261) count as unreadable.
    """
    def read(text: Column) -> Column:
        serial = text.try_cast("double")
        seconds = F.floor((serial - F.lit(_SERIAL_EPOCH_DAYS)) * F.lit(DAY) + F.lit(1e-4))
        single = F.regexp_replace(text, _BLANK, " ")
        spelled = F.lit(None).cast("timestamp")
        for start, date in reversed(MOMENT_DATES.items()):
            timed = F.lit(None).cast("timestamp")
            for part, time in reversed(MOMENT_TIMES.items()):
                timed = F.when(text.rlike(part), F.try_to_timestamp(single, F.lit(date + time))).otherwise(timed)
            spelled = F.when(text.rlike(start), timed).otherwise(spelled)
        return F.when(text.rlike(_SERIAL), F.when(F.abs(serial) < 200000, F.timestamp_seconds(seconds))).otherwise(
            F.coalesce(text.try_cast("timestamp"), spelled))

    # the text is trimmed once and the moment read once, however often the formulas name them
    moments = F.transform(F.array(trimmed(c)), read)
    return F.get(F.filter(moments, lambda m: F.year(m).between(1678, 2261)), F.lit(0))


def to_epoch(c: Column | str) -> Column:
    """Whole unix seconds of ``parse_moment``; never 0 for an unreadable value."""
    return F.unix_seconds(parse_moment(c))


def epoch_day(c: Column | str) -> Column:
    """Day number since 1970-01-01 of unix seconds, independent of the session time zone."""
    return F.floor(col(c) / F.lit(DAY)).cast("int")


def epoch_date(c: Column | str) -> Column:
    return F.date_from_unix_date(epoch_day(c))


def epoch_hour(c: Column | str) -> Column:
    return F.floor(F.pmod(col(c), F.lit(DAY)) / F.lit(3600)).cast("int")


def day_start(date: Column | str) -> Column:
    """Unix seconds of a date's midnight."""
    return F.unix_date(col(date)).cast("bigint") * F.lit(DAY)


def within(c: Column | str, low: float, high: float) -> Column:
    """The value when it lies in [low, high], otherwise NULL."""
    c = col(c)
    return F.when(c.between(low, high), c)
