"""Date, time and interval functions with this engine's rules, as column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from relquill.functions.strings import _same, col

#: Short names of units, as DATEADD, DATEDIFF, DATEPART and DATENAME take them.
UNITS = {
    "yy": "YEAR", "yyyy": "YEAR", "year": "YEAR", "qq": "QUARTER", "quarter": "QUARTER", "mm": "MONTH", "month": "MONTH",
    "dd": "DAY", "day": "DAY", "dy": "DAYOFYEAR", "dayofyear": "DAYOFYEAR", "dw": "WEEKDAY", "weekday": "WEEKDAY", "wk": "WEEK", "week": "WEEK",
    "hh": "HOUR", "hour": "HOUR", "mi": "MINUTE", "minute": "MINUTE", "ss": "SECOND", "second": "SECOND",
    "ms": "MILLISECOND", "millisecond": "MILLISECOND", "mcs": "MICROSECOND", "microsecond": "MICROSECOND", "ns": "NANOSECOND", "nanosecond": "NANOSECOND",
}

#: Tokens of TO_CHAR, TO_DATE and TO_TIMESTAMP formats, longest first, and Spark's pattern letters for them.
FORMAT = {
    "RRRR": "yyyy", "YYYY": "yyyy", "MONTH": "MMMM", "B.C.": "G", "A.D.": "G", "A.M.": "a", "P.M.": "a", "HH24": "HH", "HH12": "KK",
    "DDD": "D", "DAY": "EEEE", "MON": "MMM", "BC": "G", "AD": "G", "YY": "yy", "MM": "MM", "DD": "dd", "DY": "EEE", "HH": "HH", "MI": "mm", "SS": "ss",
    "AM": "a", "PM": "a", "FF": "SSSSSS", "TZ": "xxxxx",
}
_FF = re.compile(r"FF([1-9])", re.I)


def unit_of(name: str) -> str:
    return UNITS.get(name.lower(), name.upper().removeprefix("SQL_TSI_"))


def pattern(fmt: str) -> str:
    """Spark's datetime pattern for a format of TO_CHAR and TO_DATE. Week tokens (IYYY, IW, W) have none: use ``iso_year`` and ``week``."""
    out, i = [], 0
    while i < len(fmt):
        if m := _FF.match(fmt, i):
            out.append("S" * int(m[1]))
            i = m.end()
            continue
        token = next((t for t in FORMAT if fmt[i : i + len(t)].upper() == t), None)
        if token:
            out.append(FORMAT[token])
            i += len(token)
        elif fmt[i] == '"':
            end = fmt.find('"', i + 1)
            end = len(fmt) if end < 0 else end
            out.append("'" + fmt[i + 1 : end].replace("'", "''") + "'")
            i = end + 1
        else:
            if fmt[i].isalpha():
                raise ValueError(f"no such format token at {fmt[i:]!r}")
            out.append("''" if fmt[i] == "'" else fmt[i])
            i += 1
    return "".join(out)


def to_char(value, fmt: str) -> Column:
    return F.date_format(col(value), pattern(fmt))


def to_date(text, fmt: str) -> Column:
    """A timestamp without a fraction, as the text says by the format."""
    return F.date_trunc("second", F.to_timestamp(col(text), pattern(fmt))).cast("timestamp_ntz")


def to_timestamp(text, fmt: str) -> Column:
    return F.to_timestamp(col(text), pattern(fmt)).cast("timestamp_ntz")


def to_timestamp_tz(text, fmt: str) -> Column:
    return F.to_timestamp_ltz(col(text), F.lit(pattern(fmt)))


def add_months(d, n) -> Column:
    """The last day of a month stays a last day."""
    d = col(d).cast("date")
    return F.when(d == F.last_day(d), F.last_day(F.add_months(d, col(n)))).otherwise(F.add_months(d, col(n)))


def date_part(unit: str, ts) -> Column:
    """DATEPART and EXTRACT; whole numbers but for seconds."""
    ts = col(ts)
    field = unit_of(unit)
    by_name = {
        "DAYOFYEAR": F.dayofyear, "DAY_OF_YEAR": F.dayofyear, "WEEKDAY": F.dayofweek, "DAY_OF_WEEK": F.dayofweek, "DAY_OF_MONTH": F.dayofmonth,
        "WEEK": F.weekofyear, "WEEK_OF_YEAR": F.weekofyear, "ISO_WEEK_OF_YEAR": F.weekofyear, "DAY_NAME": day_name, "MONTH_NAME": month_name,
        "SECONDS_MIDNIGHT": seconds_midnight, "ISO_YEAR": iso_year,
    }
    if field in by_name:
        return by_name[field](ts)
    if field in ("MILLISECOND", "MICROSECOND", "NANOSECOND"):
        micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
        return {"MILLISECOND": F.floor(micros / 1000), "MICROSECOND": micros, "NANOSECOND": micros * 1000}[field].cast("long")
    return F.date_part(F.lit(field), ts)


def date_name(unit: str, ts) -> Column:
    return date_part(unit, ts).cast("string")


def date_add(unit: str, n, ts) -> Column:
    """DATEADD and TIMESTAMPADD."""
    field = unit_of(unit)
    if field in ("WEEKDAY", "DAYOFYEAR"):
        field = "DAY"
    ts, n = col(ts), col(n)
    if field == "NANOSECOND":
        field, n = "MICROSECOND", int_div(n, 1000)
    return F.timestamp_add(field, n.cast("int"), ts)


def int_div(a, b) -> Column:
    return F.call_function("div", col(a).cast("long"), col(b).cast("long"))


def date_diff(unit: str, start, end) -> Column:
    """DATEDIFF and TIMESTAMPDIFF: whole units from start to end; weeks away from zero, quarters from their starts."""
    field = unit_of(unit)
    a, b = col(start), col(end)
    if field == "WEEK":
        days = F.timestamp_diff("DAY", a, b)
        return int_div(F.when(days < 0, days - 6).otherwise(days + 6), 7)
    if field == "QUARTER":
        return int_div(F.timestamp_diff("MONTH", F.date_trunc("quarter", a), F.date_trunc("quarter", b)), 3)
    if field == "YEAR":
        return int_div(F.timestamp_diff("MONTH", F.date_trunc("month", a), F.date_trunc("month", b)), 12)
    if field == "MONTH":
        return F.timestamp_diff("MONTH", F.date_trunc("month", a), F.date_trunc("month", b)).cast("long")
    if field == "NANOSECOND":
        return F.timestamp_diff("MICROSECOND", a, b) * 1000
    return F.timestamp_diff(field, a, b).cast("long")


def days_between(a, b) -> Column:
    """The two-argument DATEDIFF: a minus b in days."""
    return F.datediff(col(a), col(b)).cast("long")


def days(d) -> Column:
    """Days since the first of January of year 1, which is day 1."""
    return (F.datediff(col(d).cast("date"), F.lit("0001-01-01").cast("date")) + 1).cast("long")


def day_name(d) -> Column:
    return F.date_format(col(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(col(d), "MMMM")


def iso_year(d) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), col(d))


def seconds_midnight(ts) -> Column:
    ts = col(ts)
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def months_between(a, b) -> Column:
    """On whole days: the time of day does not count."""
    return F.months_between(col(a).cast("date"), col(b).cast("date"))


def trunc(ts, unit: str = "DD") -> Column:
    """TRUNC of a datetime to a unit (YYYY, MM, WW, IW, DD, HH24, MI, SS)."""
    return F.date_trunc(_TRUNC[unit.upper()], col(ts))


#: Units of TRUNC and ROUND.
_TRUNC = {
    "YYYY": "year", "YY": "year", "MONTH": "month", "MON": "month", "MM": "month", "IW": "week", "WW": "week", "DDD": "day", "DD": "day",
    "HH24": "hour", "HH12": "hour", "HH": "hour", "MI": "minute", "SS": "second",
}


def round_datetime(ts, unit: str = "DD") -> Column:
    """ROUND of a datetime: up where the next smaller field is in its upper half (July still rounds down, the 16th up)."""
    ts, field = col(ts), _TRUNC[unit.upper()]
    low = F.date_trunc(field, ts)
    up = {
        "year": F.month(ts) >= 8, "month": F.day(ts) >= 16, "week": F.weekday(ts) >= 4, "day": F.hour(ts) >= 12,
        "hour": F.minute(ts) >= 30, "minute": F.second(ts) >= 30, "second": F.pmod(F.unix_millis(ts.cast("timestamp")), F.lit(1000)) >= 500,
    }[field]
    return F.when(up, F.timestamp_add(field.upper(), F.lit(1), low)).otherwise(low)


def num_to_ds_interval(n, unit: str) -> Column:
    """``n`` days, hours, minutes or seconds as a day-time interval."""
    n, unit = col(n), unit.upper()
    seconds = n.cast("decimal(18,6)") * {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def num_to_ym_interval(n, unit: str) -> Column:
    n = col(n).cast("int")
    return F.make_ym_interval(n, F.lit(0)) if unit.upper() == "YEAR" else F.make_ym_interval(F.lit(0), n)


#: SQL name -> column builder.
FUNCTIONS = {
    "ADD_MONTHS": add_months, "CURDATE": _same("current_date"), "CURRENT_DATE": _same("current_date"), "TODAY": _same("current_date"),
    "CURRENT_TIMESTAMP": _same("current_timestamp"), "SYSTIMESTAMP": _same("current_timestamp"), "LOCALTIMESTAMP": _same("localtimestamp"),
    "NOW": _same("localtimestamp"), "SYSDATE": _same("localtimestamp"), "CURRENT_TIME": _same("current_time"), "CURTIME": _same("current_time"),
    "LOCALTIME": _same("current_time"), "CURRENT_TIMEZONE": _same("current_timezone"), "DATABASE_TIMEZONE": _same("current_timezone"),
    "DBTIMEZONE": _same("current_timezone"), "SESSIONTIMEZONE": _same("current_timezone"), "SESSION_TIMEZONE": _same("current_timezone"),
    "TIMEZONE": _same("current_timezone"), "DATEADD": date_add, "TIMESTAMPADD": date_add, "DATEDIFF": date_diff, "TIMESTAMPDIFF": date_diff,
    "DATENAME": date_name, "DATEPART": date_part, "EXTRACT": date_part, "DATE_ADD": lambda d, i: col(d) + i, "DATE_SUB": lambda d, i: col(d) - i,
    "DAYNAME": day_name, "MONTHNAME": month_name, "DAYOFMONTH": _same("dayofmonth"), "DAYOFWEEK": _same("dayofweek"), "DAYOFYEAR": _same("dayofyear"),
    "DAYS": days, "DAY": _same("day"), "EOMONTH": _same("last_day"), "LAST_DAY": _same("last_day"), "HOUR": _same("hour"), "MINUTE": _same("minute"),
    "SECOND": lambda t: date_part("SECOND", t), "MONTH": _same("month"), "QUARTER": _same("quarter"), "WEEK": _same("weekofyear"), "YEAR": _same("year"),
    "MONTHS_BETWEEN": months_between, "NEXT_DAY": _same("next_day"), "NUMTODSINTERVAL": num_to_ds_interval, "NUMTOYMINTERVAL": num_to_ym_interval,
    "SECONDS_MIDNIGHT": seconds_midnight, "FROM_TZ": lambda t, z: F.to_utc_timestamp(col(t), col(z)), "SYS_EXTRACT_UTC": lambda t, z: F.to_utc_timestamp(col(t), col(z)),
    "TIMESTAMP": lambda s: col(s).cast("timestamp_ntz"), "TIMESTAMP_WITH_ZONE": lambda s: col(s).cast("timestamp"), "TO_CHAR": to_char, "TO_DATE": to_date,
    "TO_TIMESTAMP": to_timestamp, "TO_TIMESTAMP_TZ": to_timestamp_tz, "TO_DSINTERVAL": lambda s: col(s).cast("interval day to second"),
    "TO_YMINTERVAL": lambda s: col(s).cast("interval year to month"), "UNIX_MILLIS": lambda t: F.unix_millis(col(t).cast("timestamp")),
    "UNIX_TIMESTAMP": lambda t: F.unix_seconds(col(t).cast("timestamp")), "TRANSACTION_UTC": _same("current_timestamp"),
}
