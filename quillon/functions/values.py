"""Field kinds, and the text form of typed values."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import IntegerTooLarge, InvalidFieldKind, InvalidFieldValue, NotNumericField

TEXT, KEYWORD, NUMBER, DATE = "text", "keyword", "number", "date"
KINDS = (TEXT, KEYWORD, NUMBER, DATE)
MAX_EXACT_INTEGER = 1 << 53

_DECIMAL = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
_HEX = re.compile(r"[+-]?0[xX]([0-9a-fA-F]+(\.[0-9a-fA-F]*)?|\.[0-9a-fA-F]+)[pP][+-]?\d+")
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)([.,]\d+)?(Z|[+-]\d\d:\d\d)")
_DAY = re.compile(r"\d{4}-\d\d-\d\d")
#: The same rules for a column of text; an SQL cast would also take "1d", "NaN" or "2024".
DECIMAL_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_TEXT = r"^\s*\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d))?\s*$"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_kind(name: str) -> str:
    kind = name.strip().lower()
    if kind not in KINDS:
        raise InvalidFieldKind(f"{name!r} is no field kind; one of {', '.join(KINDS)}")
    return kind


def parse_number(raw: str) -> float:
    text = raw.strip()
    if _DECIMAL.fullmatch(text):
        value = float(text)
    elif _HEX.fullmatch(text):
        value = float.fromhex(text)
    else:
        raise InvalidFieldValue(f"{raw!r} is no number")
    if not math.isfinite(value):
        raise InvalidFieldValue(f"{raw!r} is no finite number")
    return value


def parse_date(raw: str) -> int:
    """Milliseconds since 1970 of an RFC 3339 time, or of a plain day at midnight UTC."""
    text = raw.strip()
    try:
        if _DAY.fullmatch(text):
            moment = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
            return round((moment - _EPOCH).total_seconds()) * 1000
        if m := _RFC3339.fullmatch(text):
            day, clock, fraction, zone = m.groups()
            moment = datetime.fromisoformat(f"{day}T{clock}{'+00:00' if zone == 'Z' else zone}")
            millis = int((fraction or ".0")[1:4].ljust(3, "0"))
            return round((moment - _EPOCH).total_seconds()) * 1000 + millis
    except ValueError:
        pass
    raise InvalidFieldValue(f"{raw!r} is no time such as 2024-01-01T10:00:00Z or 2024-01-01")


def parse_bound(kind: str, raw: str) -> float:
    if kind == NUMBER:
        return parse_number(raw)
    if kind == DATE:
        return float(parse_date(raw))
    raise NotNumericField(f"a {kind} field has no range")


def check_integer(value: int) -> float:
    if abs(value) > MAX_EXACT_INTEGER:
        raise IntegerTooLarge(f"{value} can't be stored exactly; use a keyword")
    return float(value)


def format_number(value: float) -> str:
    """The shortest text that reads back as the same number; an exponent below 1e-4 and from 1e6 on (1e+06)."""
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    mantissa, _, exponent = f"{abs(value)!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction.rstrip("0")) if fraction.strip("0") else whole
    lead = len(digits) - len(digits.lstrip("0"))
    point = len(whole) + int(exponent or 0) - lead
    digits = digits.lstrip("0").rstrip("0") or "0"
    power = point - 1
    sign = "-" if value < 0 else ""
    if power < -4 or power >= 6:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[:point].ljust(point, '0')}{'.' + digits[point:] if len(digits) > point else ''}"


def format_date(millis: int) -> str:
    """RFC 3339 in UTC with as many decimals as needed."""
    moment = _EPOCH + timedelta(milliseconds=int(millis))
    fraction = f".{int(millis) % 1000:03d}".rstrip("0").rstrip(".")
    return moment.replace(microsecond=0, tzinfo=None).isoformat() + fraction + "Z"


def millis_of(column: Column, data_type: T.DataType) -> Column:
    """Whole milliseconds since 1970 of a time column; one without a zone, or a day, is taken as UTC."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_millis(column)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))
    return F.floor(micros / 1000).cast("long")


def moment(millis: int, data_type: T.DataType) -> Column:
    """A literal of a time column's type."""
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_millis(F.lit(int(millis)))
    text = (_EPOCH + timedelta(milliseconds=int(millis))).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def number_text(value: Column) -> Column:
    """``format_number`` for a column of doubles, inside the JVM; null for null and for what is not finite.

    The JVM's text (``123.0``, ``1.5E-7``) has the digits; their places are set anew. It is the shortest from Java 19
    on; before, a few numbers near the limits of doubles have a digit more, which reads back as the same number.
    """
    text = F.abs(value).cast("string")
    part = lambda k: F.regexp_extract(text, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", k)
    digits = F.ltrim(F.concat(part(1), F.rtrim(part(2), F.lit("0"))), F.lit("0"))
    zeros = F.length(F.regexp_extract(F.concat(part(1), part(2)), "^0*", 0))
    point = F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)) - zeros
    digits = F.rtrim(digits, F.lit("0"))
    power, size = point - 1, F.length(digits)
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    scientific = F.concat(F.left(digits, F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(""), exponent)
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    plain = F.concat(F.rpad(F.left(digits, point), point, F.lit("0")), F.when(size > point, F.concat(F.lit("."), F.substring(digits, point + 1, size))).otherwise(""))
    shown = F.when(value == 0, "0").when((power < -4) | (power >= 6), scientific).when(point <= 0, below).otherwise(plain)
    negative = (value < 0) | text.startswith("-") | value.cast("string").startswith("-")
    return F.when(F.abs(value) < float("inf"), F.concat(F.when(negative, "-").otherwise(""), shown))


def date_text(millis: Column) -> Column:
    """``format_date`` for a column of milliseconds since 1970, inside the JVM."""
    seconds, rest = F.floor(millis / 1000), F.pmod(millis, F.lit(1000))
    fraction = F.rtrim(F.rtrim(F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0")), F.lit("0")), F.lit("."))
    day = F.dateadd(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    clock = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), two(clock / 3600), F.lit(":"), two(F.pmod(clock, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(clock, F.lit(60))), fraction, F.lit("Z"))
