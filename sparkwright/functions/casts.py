"""Lenient conversions that never raise under ANSI mode.

Spark's own casts are more forgiving than wanted (``try_cast('10d' as double)`` is 10.0,
``'2024'`` casts to a timestamp), so text is checked by pattern before it is cast.
All helpers return plain Columns: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number (optional sign, digits, optional fraction,
# optional exponent, surrounding blanks allowed).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Accepted date/time layouts. Numbers may be padded or not. Where the year is
# last the month comes first; where that is impossible the day does.
_TIME = r"\d{1,2}:\d{1,2}(?::\d{1,2})?"
DATE_LAYOUTS = {
    "iso": rf"\A\d{{4}}-\d{{1,2}}(?:-\d{{1,2}}(?:[ T](?:{_TIME}|\d{{1,2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?))?)?\z",
    "year/": r"\A\d{4}/\d{1,2}/\d{1,2}(?: \d{1,2}:\d{1,2}:\d{1,2})?\z",
    "digits": r"\A(\d{4})(\d{2})(\d{2})\z",
    "year last": rf"\A(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})((?<=/\d{{4}}) {_TIME}(?: [AaPp][Mm])?)?\z",
    "day name": r"\A\d{1,2} [A-Z]{3,9} \d{4}\z",
    "name": r"\A[A-Z]{3,9} \d{1,2} \d{4}\z",
}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC",
          "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]

_BLANKS = " \t\n\r\x0b\x0c"

# Boolean spellings.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_string_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Numeric view of a column, null where the value is not a number.

    Numbers pass through as double (NaN becomes null), booleans become 1/0, text is
    cast only when it looks like a number, anything else is null.
    """
    col = _col(c)
    if dtype is None or is_string_type(dtype):
        text = col.cast("string")
        # Cheap first-character test before the regex: most non-numeric text stops here.
        first = F.ascii(text)
        maybe = (first.between(48, 57) | first.isin(43, 45, 46, 32, 9, 10, 13))
        value = F.when(maybe & text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, T.BooleanType):
        return col.cast("double")
    if is_numeric_type(dtype):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    return F.lit(None).cast("double")


def parse_dates(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Mixed-format date parsing; failures become null."""
    col = _col(c)
    if isinstance(dtype, T.TimestampType):
        return col
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return col.cast("timestamp")
    if dtype is not None and not is_string_type(dtype):
        return F.lit(None).cast("timestamp")
    text = F.trim(col.cast("string"))
    first = F.ascii(text)
    digit = first.between(48, 57)
    letter = first.between(65, 90) | first.between(97, 122)
    sep5 = F.substring(text, 5, 1)
    fits = lambda x, layout: x.rlike(DATE_LAYOUTS[layout])

    def named(value: Column, month: int, day: int) -> Column:
        word = lambda i: F.get(F.split(value, " "), F.lit(i))
        at = F.array_position(F.array(*map(F.lit, MONTHS)), word(month))  # 0: not a month, nor is the text a date
        return F.concat_ws("-", word(2), ((at - 1) % 12 + 1).cast("string"), word(day))

    # Every layout is rewritten year first and cast once: the cast reads digits without a
    # format and answers null for an impossible date.
    year_last = F.regexp_replace(text, DATE_LAYOUTS["year last"], F.when(text.rlike(r"\A(?:1[3-9]|[2-9]\d)"), F.lit("$4-$3-$1$5")).otherwise(F.lit("$4-$1-$3$5")))
    upper = F.upper(text)
    bare = F.replace(upper, F.lit(","), F.lit(""))
    rewritten = (F.when(digit & (sep5 == "-") & fits(text, "iso"), text)
                 .when(digit & (sep5 == "/") & fits(text, "year/"), F.translate(text, "/", "-"))
                 .when(digit & fits(text, "year last"), year_last)
                 .when(digit & F.contains(text, F.lit(" ")) & fits(upper, "day name"), named(upper, 1, 0))
                 .when(digit & fits(text, "digits"), F.regexp_replace(text, DATE_LAYOUTS["digits"], "$1-$2-$3"))
                 .when(letter & fits(bare, "name"), named(bare, 0, 1)))
    half_day = digit & F.right(upper, F.lit(2)).isin("AM", "PM")
    return (F.when(~half_day, rewritten.try_cast("timestamp"))
            .when(fits(text, "year last"), F.try_to_timestamp(F.upper(year_last), F.lit("yyyy-M-d h:m[:s] a"))))


def clean_text(c: str | Column) -> Column:
    """String view, surrounding blanks removed, empty text as null."""
    text = F.btrim(_col(c).cast("string"), F.lit(_BLANKS))
    return F.when(text != "", text)


def to_boolean(c: str | Column, dtype: T.DataType | None = None) -> Column:
    col = _col(c)
    if isinstance(dtype, T.BooleanType):
        return col
    norm = F.lower(F.trim(col.cast("string")))
    return (F.when(norm.isin(TRUE_WORDS), F.lit(True))
            .when(norm.isin(FALSE_WORDS), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


def as_bool_flag(cond: Column) -> Column:
    """Null-safe flag: a comparison with a null is false, never null."""
    return F.coalesce(cond, F.lit(False))


def money(c: str | Column) -> Column:
    """Exact decimal view used for sums so the addition order cannot change a digit."""
    return _col(c).cast(T.DecimalType(38, 6))


def exact(c: str | Column) -> Column:
    """Decimal view with twelve places, for sums of quantities and generic measures."""
    return _col(c).try_cast(T.DecimalType(38, 12))


def exact_sum(c: str | Column) -> Column:
    """Sum as double whose digits do not depend on the order of addition.

    Values that the decimal view cannot hold (infinities, 1e20 and more) are summed as doubles.
    """
    value = _col(c).cast("double")
    return F.when(F.max(F.abs(value)) < 1e20, F.sum(exact(value)).cast("double")).otherwise(F.sum(value))


def round_half_even(c: Column, scale: int) -> Column:
    """Python/pandas-style rounding of an exact decimal, returned as double."""
    return F.bround(c.cast(T.DecimalType(38, 10)), scale).cast("double")
