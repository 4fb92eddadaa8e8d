"""Dates as ISO strings: what the sources write is kept, offset included."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, let, non_empty

# Date formats tried in this order.
#   1. post date      Sat May 15 12:55:25 +0000 2021   (result has no offset)
#   2. ISO 8601       2021-05-15T12:55:25Z, 20210515, 2021-05, 2021, ...
#   3. year-month-day 2021-5-1
#   4. year/month/day 2021/5/1
_POST = (
    r"(?i)\A(?:mon|tue|wed|thu|fri|sat|sun)\s+"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+([0-9]{1,2})\s+"
    r"([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\s+(?:utc|gmt)\s+([0-9]{4})\z"
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_ISO_DAY = r"\A([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?|([0-9]{2})([0-9]{2}))?"
_ISO_TIME = (
    r"(?:(?s:.)([0-9]{2})(?:(:?)([0-9]{2})(?:\7([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(Z|z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?\z"
)
_ISO = _ISO_DAY + _ISO_TIME
# A time needs a whole day in front of it.
_TIME_WITHOUT_DAY = r"\A[0-9]{4}(?:-[0-9]{2})?(?![0-9-])(?s:.)"


def _pad(c, width=2) -> Column:
    return F.lpad(c, width, "0")


def _stamp(year, month, day, hour, minute, second) -> Column:
    """ISO date and time to the second, or NULL if there is no such moment."""
    text = F.concat(
        _pad(year, 4), F.lit("-"), _pad(month), F.lit("-"), _pad(day),
        F.lit("T"), _pad(hour), F.lit(":"), _pad(minute), F.lit(":"), _pad(second),
    )
    return let(
        text, lambda t: F.when(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), t)
    )


def _groups(c, pattern, count) -> Column:
    return F.struct(*[F.regexp_extract(c, pattern, n).alias(f"g{n}") for n in range(1, count + 1)])


def _post_date(c) -> Column:
    def stamp(g):
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(g["g1"])).cast("string")
        return _stamp(g["g6"], month, g["g2"], g["g3"], g["g4"], g["g5"])

    utc = F.replace(c, F.lit(" +0000 "), F.lit(" UTC "))
    return F.when(c.rlike("(?i)^[a-z]{3} "), F.when(utc.rlike(_POST), let(_groups(utc, _POST, 6), stamp)))


def _zone_offset(zone) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hour, minute = F.substring(digits, 1, 2), F.rpad(F.substring(digits, 3, 2), 2, "0")
    return (
        F.when(zone == "", F.lit(""))
        .when((zone == "Z") | (F.concat(hour, minute) == "0000"), F.lit("+00:00"))
        .when(
            (hour <= "23") & (minute <= "59"),
            F.concat(F.substring(zone, 1, 1), hour, F.lit(":"), minute),
        )
    )


def _iso_text(g) -> Column:
    zero = F.lit("00")
    month = F.coalesce(non_empty(g["g2"]), non_empty(g["g4"]), F.lit("01"))
    day = F.coalesce(non_empty(g["g3"]), non_empty(g["g5"]), F.lit("01"))
    hour, minute, second = [F.coalesce(non_empty(g[n]), zero) for n in ("g6", "g8", "g9")]
    micros = F.rpad(F.substring(g["g10"], 1, 6), 6, "0")
    fraction = F.when(micros.rlike("[1-9]"), F.concat(F.lit("."), micros)).otherwise(F.lit(""))
    # 24:00 is midnight of the next day.
    midnight = (hour == "24") & (minute == zero) & (second == zero) & (fraction == "")
    first_moment = _stamp(g["g1"], month, day, zero, zero, zero)
    next_day = F.date_format(
        F.date_add(F.substring(first_moment, 1, 10).try_cast("date"), 1), "yyyy-MM-dd'T'HH:mm:ss"
    )
    moment = F.when(midnight, next_day).otherwise(_stamp(g["g1"], month, day, hour, minute, second))
    return F.concat(moment, fraction, _zone_offset(F.upper(g["g11"])))


def iso_date(c) -> Column:
    """An ISO 8601 date in full form (…T00:00:00 when it has no time), or NULL."""
    return let(
        c,
        lambda c: F.when(
            c.rlike(_ISO) & ~c.rlike(_TIME_WITHOUT_DAY), let(_groups(c, _ISO, 11), _iso_text)
        ),
    )


def _slack_date(c, separator) -> Column:
    pattern = rf"\A([0-9]{{4}}){separator}([0-9]{{1,2}}){separator}([0-9]{{1,2}})\z"
    zero = F.lit("0")
    return F.when(
        c.rlike(pattern),
        let(_groups(c, pattern, 3), lambda g: _stamp(g["g1"], g["g2"], g["g3"], zero, zero, zero)),
    )


def parse_date(c) -> Column:
    """First format that fits, as an ISO string; NULL when none does."""
    return let(
        c,
        lambda c: F.coalesce(_post_date(c), iso_date(c), _slack_date(c, "-"), _slack_date(c, "/")),
    )


def epoch_date(c, zone="UTC") -> Column:
    """Epoch seconds in a string → date and time in ``zone``, whatever the session's zone."""
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=col(c).try_cast("decimal(18,0)")
    )
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM-dd'T'HH:mm:ss")


def date_year(c) -> Column:
    """Year of an ISO string, '?' when there is none."""
    year = F.substring(iso_date(c), 1, 4)
    return F.coalesce(F.regexp_replace(year, r"\A0+(?=[0-9])", ""), F.lit("?"))
