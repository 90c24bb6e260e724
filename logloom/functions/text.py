"""Text functions on columns: trimming, quote and line markers, SQL shapes, numbers, decoding.

They take and return Columns, so they work on any text column, not only on log events.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that stand for line breaks and doubled quotes while an event is one string.
NEWLINE_MARK = "<_NL_>"
DOUBLE_QUOTE_MARK = "<DQ>"
SINGLE_QUOTE_MARK = "<OQ>"

# Replacements written into normalised SQL.
SQL_PARAMETER = "_PARAM_"
SQL_TEMP_TABLE = "pg_temp_table"

# The literals and temporary tables recognised in SQL text, tried in this order.
SQL_LITERALS = (
    r"'\\[^']*'::bytea",
    r"'\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'::\w+",
    r"'\w*'",
    r"\b\d+\.\d+\b",
    r"\b\d+\b",
    r"\bpg_temp\.\w+\b",
    r"VALUES\s*\([^)]+\)",
)

# What any of them starts with; looking for that first passes over ordinary text quickly.
_LITERAL_START = r"(?=['\dpV])"

# Every character for which Python's str.isspace() holds; all lie below U+3001.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Unicode noncharacters, used to bracket a match between two regexp_replace passes.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER = r"^[+-]?[0-9]+\z"

# The upper half of the windows-1251 code page, against the same bytes read as latin-1.
_UPPER = bytes(range(128, 256))
_LATIN1_UPPER = _UPPER.decode("latin-1")
_CP1251_UPPER = _UPPER.decode("cp1251", errors="replace")


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_line(c: Column) -> Column:
    """Trim a log line and mark its doubled quotes, so that quoted values can be matched simply."""
    return F.replace(
        F.replace(strip(c), F.lit('""'), F.lit(DOUBLE_QUOTE_MARK)), F.lit("''"), F.lit(SINGLE_QUOTE_MARK)
    )


def restore_quotes(c: Column) -> Column:
    return F.replace(
        F.replace(c, F.lit(DOUBLE_QUOTE_MARK), F.lit('""')), F.lit(SINGLE_QUOTE_MARK), F.lit("''")
    )


def restore_newlines(c: Column) -> Column:
    return F.replace(c, F.lit(NEWLINE_MARK), F.lit("\n"))


def last_line(c: Column, separator: str = NEWLINE_MARK) -> Column:
    """The text after the last separator; all of it if there is none."""
    return F.substring_index(c, separator, -1)


def normalize_sql(c: Column) -> Column:
    """Replace literals by `_PARAM_` and temporary tables by one name, so equal statements compare equal.

    A single pass brackets every match, which settles which alternative wins at each place; the
    bracketed spans are then rewritten.
    """
    literal = f"(?U){_LITERAL_START}(?:{'|'.join(SQL_LITERALS)})"
    marked = F.regexp_replace(c, literal, _OPEN + "$0" + _CLOSE)
    inside = f"[^{_CLOSE}]*"
    temp = F.regexp_replace(marked, f"{_OPEN}{inside}?pg_temp{inside}{_CLOSE}", SQL_TEMP_TABLE)
    return F.regexp_replace(temp, f"{_OPEN}{inside}{_CLOSE}", SQL_PARAMETER)


def is_number(c: Column) -> Column:
    """Whether text reads as a plain decimal number."""
    return c.rlike(NUMBER)


def to_number(c: Column) -> Column:
    """Text as DOUBLE; NULL for anything that is not a plain decimal number."""
    return F.when(is_number(c), c.try_cast("double"))


def to_integer(c: Column) -> Column:
    """Text as BIGINT without going through DOUBLE; whole numbers such as `5.0` or `1e3` also count."""
    whole = to_number(c)
    return F.when(c.rlike(INTEGER), c.try_cast("bigint")).otherwise(
        F.when(whole == F.floor(whole), whole.try_cast("bigint"))
    )


def from_cp1251(c: Column) -> Column:
    """Decode the bytes of a string column as windows-1251."""
    latin = F.decode(c.cast("binary"), "ISO-8859-1")
    return F.translate(latin, _LATIN1_UPPER, _CP1251_UPPER)


def utf8_evidence(c: Column) -> tuple[Column, Column]:
    """Of undecoded bytes: how many characters lie beyond ASCII if read as UTF-8, and how many of these are broken."""
    repaired = F.make_valid_utf8(c)
    return F.length(F.regexp_replace(repaired, r"[\x00-\x7F]+", "")), F.length(F.regexp_replace(repaired, "[^\ufffd]+", ""))


def is_cp1251(wide: Column, broken: Column) -> Column:
    """What evidence says: most of what lies beyond ASCII is broken as UTF-8."""
    return broken * 2 > wide


def decode_text(c: Column, encoding: str | Column = "auto") -> Column:
    """Turn a string column that holds undecoded bytes into valid text.

    `auto` decides line by line: valid UTF-8 stays; a line whose non-ASCII part is mostly broken as
    UTF-8 is read as windows-1251; otherwise its few broken bytes become U+FFFD. A column tells for
    each row whether it is windows-1251.
    """
    repaired = F.make_valid_utf8(c)
    if isinstance(encoding, Column):
        return F.when(encoding, from_cp1251(c)).otherwise(repaired)
    if encoding == "utf-8":
        return repaired
    if encoding == "cp1251":
        return from_cp1251(c)
    if encoding != "auto":
        raise ValueError(f"unknown encoding {encoding!r}: use auto, utf-8 or cp1251, or file for logs")
    return F.when(F.is_valid_utf8(c), c).when(is_cp1251(*utf8_evidence(c)), from_cp1251(c)).otherwise(repaired)
