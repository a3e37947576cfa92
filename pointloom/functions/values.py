"""Strict conversions between text and the four kinds, as column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# The accepted number form, time form and white space.
NUMBER_PATTERN = r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"
DAY, ZONE = r"(\d{4}-\d{2}-\d{2})", r"(Z|[+-]\d{2}:?\d{2})?"
TIME_PATTERN = (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?"
                r"(?:Z|[+-](?:0\d|1[0-3]):?[0-5]\d|[+-]14:?00)$")
SPACES = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000\ufeff")

MAX_DOUBLE = 1.7976931348623157e308
MIN_DOUBLE = 5e-324


def trimmed(c: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    # Hardly any text needs it, and the test is much cheaper than the cut.
    return F.when(F.rlike(c, F.lit(f"^[{SPACES}]|[{SPACES}]$")), F.trim(c, F.lit(SPACES))).otherwise(c)


def is_blank(c: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def finite(v: Column) -> Column:
    """The double itself, or null for NaN and infinities."""
    return F.when(F.abs(v) <= F.lit(MAX_DOUBLE), v)


def clamp(v: Column, low: float, high: float) -> Column:
    """The value held inside a range; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def number_in(t: Column) -> Column:
    """A decimal in trimmed text, or null; hexadecimal, ``Infinity`` and suffixes are refused.

    Text beyond the range of doubles still gives an infinity, see :func:`finite`.
    """
    return F.when(F.rlike(t, F.lit(NUMBER_PATTERN)), t.try_cast("double"))


def to_number(text: Column) -> Column:
    """A finite decimal in text with white space around it, or null."""
    return finite(number_in(trimmed(text)))


def boolean_in(t: Column) -> Column:
    """``true``/``false`` in any case, or null; for trimmed text."""
    low = F.lower(t)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def to_boolean(text: Column) -> Column:
    """:func:`boolean_in` for text with white space around it."""
    return boolean_in(trimmed(text))


def to_flag(text: Column) -> Column:
    """Service booleans: ``true``, ``false``, ``1`` and ``0``; anything else is null."""
    return (F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)))


def parse_utc(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp in whole milliseconds, or null.

    Unzoned means UTC; offsets reach ±14:00; out-of-range days or hours do not roll over.
    """
    return time_in(trimmed(text))


def time_in(t: Column) -> Column:
    """:func:`parse_utc` for trimmed text.

    The accepted forms are completed step by step to one form that Spark casts itself.
    """
    t = F.upper(t)
    t = F.regexp_replace(t, f"^{DAY}{ZONE}$", "$1T00:00:00$2")
    t = F.regexp_replace(t, rf"^{DAY}[T ](\d{{2}}:\d{{2}}){ZONE}$", "$1T$2:00$3")
    t = F.regexp_replace(t, rf"^{DAY}[T ](\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,9}})?)$", "$1T$2Z")
    return F.date_trunc("MILLISECOND", F.regexp_extract(t, TIME_PATTERN, 0).try_cast("timestamp"))


def utc_iso(ts: Column) -> Column:
    """``2024-01-31T12:00:00.000Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_utc(ts: Column) -> Column:
    """``2024-01-31 12:00:00 UTC``; milliseconds appear only when they are not zero."""
    shown = F.regexp_replace(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), r"\.000$", "")
    return F.coalesce(F.concat(shown, F.lit(" UTC")), F.lit("Invalid UTC time"))


def number_text(v: Column) -> Column:
    """A double the way people write it: ``12`` not ``12.0``, plain digits from 1e-6 to 1e21."""
    java = v.cast("string")
    size = F.abs(v)
    whole = (F.floor(v) == v)
    plain_big = F.regexp_replace(java.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    plain_small = F.regexp_replace(java.try_cast("decimal(38,26)").cast("string"), r"\.?0+$", "")
    return (F.when(v == 0, F.lit("0"))
            .when(whole & (size < 1e18), v.try_cast("bigint").cast("string"))
            .when(whole & (size < 1e21), java.try_cast("decimal(38,0)").cast("string"))
            .when(size >= 1e21, F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), "E", "e+"))
            .when(size >= 1e7, plain_big)
            .when(size >= 1e-3, java)
            .when(size >= 1e-6, plain_small)
            .otherwise(F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), "E", "e")))


def value_text(c: Column, kind: str) -> Column:
    """The plain text of a stored value; null stays null."""
    if kind == "number":
        return number_text(c.cast("double"))
    if kind == "date":
        return utc_iso(c)
    return c.cast("string")


def search_text(c: Column, kind: str) -> Column:
    """The text a search looks at; a missing value is the word ``null``."""
    return F.coalesce(value_text(c, kind), F.lit("null"))


def to_text(c: Column) -> Column:
    """Nested values as JSON text."""
    return F.to_json(c)


def natural_key(text: Column) -> Column:
    """A sort key in which digit runs order by value and letters by the root locale."""
    padded = F.regexp_replace(text, r"(\d+)", "0" * 40 + "$1")
    return F.collate(F.regexp_replace(padded, r"0+(\d{40,})(?!\d)", "$1"), "UNICODE")


# The same rules for single literals on the driver.

_CYCLE = timedelta(days=146097)  # 400 Gregorian years, which moves year 0 into Python's range


def _digits(text: str, *widths: int) -> bool:
    return len(text) in widths and text.isascii() and text.isdigit()


def _zone(text: str) -> timedelta | None:
    """The offset that a zone text stands for."""
    if text in ("", "Z", "z"):
        return timedelta(0)
    body = text[1:].replace(":", "", 1) if text[3:4] == ":" else text[1:]
    if text[0] not in "+-" or not _digits(body, 4):
        return None
    offset = timedelta(hours=int(body[:2]), minutes=int(body[2:]))
    return None if body[2:] > "59" or offset > timedelta(hours=14) else offset if text[0] == "+" else -offset


def _clock(text: str) -> timedelta | None:
    """Time of day from ``hh:mm``, ``hh:mm:ss`` or that with up to nine decimals; whole milliseconds count."""
    whole, dot, decimals = text.partition(".")
    parts = whole.split(":")
    if len(parts) not in (2, 3) or not all(_digits(p, 2) for p in parts) or dot and not (len(parts) == 3 and _digits(decimals, *range(1, 10))):
        return None
    numbers = [int(p) for p in parts] + [0]
    if numbers[0] > 23 or max(numbers[1:]) > 59:
        return None
    return timedelta(hours=numbers[0], minutes=numbers[1], seconds=numbers[2], milliseconds=int((decimals + "000")[:3]))


def parse_utc_millis(text: str) -> int | None:
    """Epoch milliseconds of a time literal, or None: a date, and by choice a clock and a zone behind it."""
    text = text.strip()
    day, rest = text[:10], text[10:]
    if not (_digits(day[:4], 4) and day[4:5] == day[7:8] == "-" and _digits(day[5:7], 2) and _digits(day[8:], 2)):
        return None
    clock = timedelta(0)
    if rest[:1] in ("T", "t", " "):
        ends = [i for i in map(rest.find, "Zz+-") if i > 0]
        at = min(ends, default=len(rest))
        clock, rest = _clock(rest[1:at]), rest[at:]
    zone = _zone(rest)
    if clock is None or zone is None:
        return None
    try:
        date = datetime(int(day[:4]) + 400, int(day[5:7]), int(day[8:]))
    except ValueError:
        return None
    return (date - datetime(1970, 1, 1) - _CYCLE + clock - zone) // timedelta(milliseconds=1)


def iso_from_millis(millis: int) -> str:
    """ISO text with milliseconds for a driver-side literal."""
    stamp = datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=int(millis))
    return f"{stamp:%Y-%m-%dT%H:%M:%S}.{stamp.microsecond // 1000:03d}Z".rjust(24, "0")


def shown_from_millis(millis: int) -> str:
    """Display text for a driver-side time literal; milliseconds appear only when they are not zero."""
    seconds, rest = divmod(int(millis), 1000)
    stamp = datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=seconds)
    day, clock = f"{stamp.year:04d}-{stamp.month:02d}-{stamp.day:02d}", f"{stamp.hour:02d}:{stamp.minute:02d}:{stamp.second:02d}"
    return f"{day} {clock}{f'.{rest:03d}' if rest else ''} UTC"


def literal_text(v: float) -> str:
    """Shortest text of a driver-side number, without a trailing ``.0``."""
    text = repr(float(v))
    return text[:-2] if text.endswith(".0") else text


def short_number(v: float) -> str:
    """Four significant digits, for labels."""
    return literal_text(float(f"{v:.4g}"))
