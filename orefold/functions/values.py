"""Cell-level expressions: missing values, number and date parsing, text cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points of white space, by rule from the Unicode tables.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

# The words that count as booleans.
BOOLEAN_WORDS = ("true", "false", "yes", "no")

DIGITS = r"^[0-9]+$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ZERO_ONE = r"^\s*[01]\s*$"
BOOLEAN = r"(?i)^\s*(true|false|yes|no)\s*$"
FLOAT_WORD = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"

_ISO_TIMESTAMP = (
    r"^(\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}(?::\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?)?)?)"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?$"
)
_YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
_DAY_FIRST = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"


def col(name: str) -> Column:
    """The column of exactly this name, which may hold dots and spaces."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """The name as SQL reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def cols(names: Iterable[str]) -> list[Column]:
    return [col(name) for name in names]


def text(df: DataFrame, name: str) -> Column:
    """A column as text, whatever its type."""
    column = col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return column
    return column.cast("string")


def is_missing(value: Column) -> Column:
    """Null or the empty text."""
    return value.isNull() | (value == "")


def is_blank(value: Column) -> Column:
    """Null, empty, or white space only. Trimming one end says so, and it stops at the first
    other character."""
    return value.isNull() | (F.ltrim(value, F.lit(WHITESPACE)) == "")


def present(value: Column) -> Column:
    """The value itself, with the empty text turned into null."""
    return F.when(value != "", value)


def strip(value: Column) -> Column:
    """Remove white space, Unicode spaces included, at both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def normalize_text(value: Column) -> Column:
    """Strip, then turn every inner run of white space into one space."""
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def is_integer_text(value: Column) -> Column:
    return value.rlike(INTEGER)


def is_float_text(value: Column) -> Column:
    return value.rlike(FLOAT) | value.rlike(FLOAT_WORD)


def to_integer(value: Column) -> Column:
    """Whole numbers only: ``"3.0"`` gives null."""
    return F.when(is_integer_text(value), value.try_cast("bigint"))


def to_double(value: Column) -> Column:
    """Any float text, exponents and the words nan and inf included; else null."""
    return F.when(is_float_text(value), value.try_cast("double"))


def to_truncated_integer(value: Column) -> Column:
    """Parse as float, then cut the fraction toward zero."""
    return to_double(value).try_cast("bigint")


def to_number(value: Column) -> Column:
    """Lenient measure parse: a decimal when the text has a dot, else a whole number."""
    decimal = value.contains(".") & value.rlike(FLOAT)
    return F.when(decimal | value.rlike(INTEGER), value.try_cast("double"))


def coerce_number(value: Column) -> Column:
    """Parse like a data frame coercion: whatever is no number becomes null."""
    number = to_double(value)
    return F.when(~F.isnan(number), number)


def number(df: DataFrame, name: str, lenient: bool = True) -> Column:
    """A measure column as double; typed columns pass through, NaN counts as null."""
    column = col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return to_number(column) if lenient else coerce_number(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    return F.lit(None).cast("double")


def parse_date(value: Column) -> Column:
    """Dates in ISO, year-first slash, day-first and compact form; else null.

    A time zone suffix is dropped and the written wall-clock time is kept. The common
    ISO form needs one pattern; the others are tried only where it does not match.
    """
    cleaned = strip(value)
    iso = F.regexp_extract(cleaned, _ISO_TIMESTAMP, 1)
    year_first = F.regexp_replace(cleaned, _YEAR_FIRST, "$1-$2-$3")
    day_first = F.regexp_replace(year_first, _DAY_FIRST, "$4-$3-$1")
    compact = F.regexp_replace(day_first, _COMPACT, "$1-$2-$3")
    other = F.regexp_extract(compact, _ISO_TIMESTAMP, 1)
    return F.coalesce(iso.try_cast("timestamp_ntz"), other.try_cast("timestamp_ntz"))


def timestamp(df: DataFrame, name: str) -> Column:
    """A date column as a zone-free timestamp, parsed only when it is text."""
    column = col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp_ntz")
    return parse_date(column.cast("string"))


def equals_ignoring_case(value: Column, wanted: str) -> Column:
    """Equality after trimming and lower-casing both sides."""
    return F.lower(strip(value)) == wanted.strip().lower()


def contains_any(value: Column, words: list[str]) -> Column:
    """True when the text holds at least one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | value.contains(word)
    return found


_EXACT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _exact_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly where grouping finds the values equal."""
    kind, column = df.schema[name].dataType, col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Adding zero gives both zeros one sign.
        return (column + F.lit(0.0)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, (T.StructType, T.ArrayType)):
        # Nested times with all their microseconds.
        return F.to_json(F.struct(column), _EXACT_TIMES)
    return column.cast("string")


def row_digest(df: DataFrame, names: Iterable[str]) -> Column:
    """The SHA-256 of a row's columns, 32 bytes however wide the row is.

    Every cell comes with its length, and null is no length, so neither shifted borders
    nor separators in the data make different rows equal.
    """
    cells = []
    for name in names:
        value = _exact_text(df, name)
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        cells.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*cells, F.lit("")), 256))


def digest(value: Column) -> Column:
    """The SHA-256 of a text as 32 bytes; null stays null."""
    return F.unhex(F.sha2(value, 256))
