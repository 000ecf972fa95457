"""Scalar functions F-1 .. F-15: Column in, Column out.

All are built-in expressions, so they stay inside whole-stage codegen and
can be pushed and pruned by Catalyst.  Time functions are integer arithmetic
on the epoch milliseconds: UTC whatever the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page names of the event log the engine keys on.
CANCELLATION_PAGE = "Cancellation Confirmation"
PLAY_PAGE = "NextSong"
THUMBS_UP_PAGE = "Thumbs Up"
THUMBS_DOWN_PAGE = "Thumbs Down"
ADD_FRIEND_PAGE = "Add Friend"

# First ';' piece of the first parenthesised user-agent group -> platform.
PLATFORMS = {
    "compatible": "Windows",
    "iPad": "iPad",
    "iPhone": "iPhone",
    "Macintosh": "Mac",
    "Windows NT 5.1": "Windows",
    "Windows NT 6.0": "Windows",
    "Windows NT 6.1": "Windows",
    "Windows NT 6.2": "Windows",
    "Windows NT 6.3": "Windows",
    "X11": "Linux",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


MILLIS_PER_DAY = 86_400_000
MILLIS_PER_HOUR = 3_600_000


def event_day(ts) -> Column:
    """Whole UTC days since 1970-01-01 (the cheap grouping key of a date)."""
    return F.floor(_col(ts) / MILLIS_PER_DAY).cast("int")


def day_date(day) -> Column:
    """``event_day`` as a date."""
    return F.date_add(F.lit("1970-01-01").cast("date"), _col(day))


def event_date(ts) -> Column:
    """F-1: epoch ms to a ``yyyy-MM-dd`` string (UTC)."""
    return day_date(event_day(ts)).cast("string")


def event_datetime(ts) -> Column:
    """F-2: epoch ms to ``yyyy-MM-dd HH:mm:ss`` (UTC; the reference used the machine zone)."""
    second = F.pmod(F.floor(_col(ts) / 1000), F.lit(86_400)).cast("int")
    part = lambda x, n: F.pmod(F.floor(x / n).cast("int"), F.lit(60))
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600).cast("int"), part(second, 60), part(second, 1))
    return F.concat(event_date(ts), F.lit(" "), clock)


def hour_of(ts) -> Column:
    """F-3: hour 0..23 as an int."""
    return F.pmod(F.floor(_col(ts) / MILLIS_PER_HOUR), F.lit(24)).cast("int")


def day_of(ts) -> Column:
    """F-3: day of month 1..31 as an int."""
    return F.dayofmonth(day_date(event_day(ts)))


def weekday_of(ts) -> Column:
    """F-3: weekday with 0 = Sunday (strftime ``%w``)."""
    return F.dayofweek(day_date(event_day(ts))) - 1


# English weekday names, Sunday first.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def weekday_name(ts) -> Column:
    """F-4: English weekday name."""
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), weekday_of(ts))


def days_active(first_date, as_of: str) -> Column:
    """F-5: whole days from the first event date to ``as_of`` (required, no 'now')."""
    return F.datediff(F.to_date(F.lit(as_of)), F.to_date(_col(first_date)))


def state_code(location) -> Column:
    """F-6: last comma piece, trimmed; if longer than 2, its last hyphen piece, trimmed."""
    piece = F.trim(F.element_at(F.split(_col(location), ","), -1))
    return F.when(F.length(piece) > 2, F.trim(F.element_at(F.split(piece, "-"), -1))).otherwise(piece)


def city(location) -> Column:
    """F-7: text before the first comma."""
    return F.get(F.split(_col(location), ","), 0)


def state_group(location) -> Column:
    """F-7: the whole piece after the first comma, trimmed (``NY-NJ-PA``); null without a comma."""
    return F.trim(F.get(F.split(_col(location), ","), 1))


def browser(user_agent) -> Column:
    """F-8: Firefox, then Chrome (Safari and Chrome), Safari, IE (Trident); else null."""
    ua = _col(user_agent)
    return (
        F.when(ua.contains("Firefox"), F.lit("Firefox"))
        .when(ua.contains("Safari") & ua.contains("Chrome"), F.lit("Chrome"))
        .when(ua.contains("Safari"), F.lit("Safari"))
        .when(ua.contains("Trident"), F.lit("IE"))
    )


def platform(user_agent) -> Column:
    """F-9: platform of the first parenthesised group's first ';' piece; null if unknown."""
    group = F.regexp_extract(_col(user_agent), r"\(([^\)]*)\)", 1)
    key = F.get(F.split(group, ";"), 0)
    lookup = F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv])
    return F.try_element_at(lookup, key)


def flag(column, value) -> Column:
    """F-10: 1 when equal, else 0 (null gives 0)."""
    return F.when(_col(column) == F.lit(value), F.lit(1)).otherwise(F.lit(0))


def round2(x) -> Column:
    """F-12: round half up to 2 places."""
    return F.round(_col(x), 2)


def ratio(numerator, denominator) -> Column:
    """F-13: ratio as double; null when the divisor is 0."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def gender_code(word) -> Column:
    """F-14: ``male`` -> ``M``, anything else -> ``F``."""
    return F.when(_col(word) == "male", F.lit("M")).otherwise(F.lit("F"))


def min_max_scale(x, lo, hi) -> Column:
    """F-15: ``(x - lo) / (hi - lo)``; null when the range is empty."""
    return F.try_divide((_col(x) - _col(lo)).cast("double"), (_col(hi) - _col(lo)).cast("double"))


# Coefficients of W. J. Cody's rational approximations of erf
# and erfc (Mathematics of Computation 23, 1969), highest order last.
_ERF_P = [3.209377589138469472562e3, 3.774852376853020208137e2, 1.138641541510501556495e2, 3.161123743870565596947e0, 1.857777061846031526730e-1]
_ERF_Q = [2.844236833439170622273e3, 1.282616526077372275645e3, 2.440246379344441733056e2, 2.360129095234412093499e1, 1.0]
_ERFC_P = [
    1.23033935479799725272e3, 2.05107837782607146532e3, 1.71204761263407058314e3, 8.81952221241769090411e2,
    2.98635138197400131132e2, 6.61191906371416294775e1, 8.88314979438837594118e0, 5.64188496988670089180e-1, 2.15311535474403846343e-8,
]
_ERFC_Q = [
    1.23033935480374942043e3, 3.43936767414372163696e3, 4.36261909014324715820e3, 3.29079923573345962678e3,
    1.62138957456669018874e3, 5.37181101862009857509e2, 1.17693950891312499305e2, 1.57449261107098347253e1, 1.0,
]
_TAIL_P = [-6.58749161529837803157e-4, -1.60837851487422766278e-2, -1.25781726111229246204e-1, -3.60344899949804439429e-1, -3.05326634961232344035e-1, -1.63153871373020978498e-2]
_TAIL_Q = [2.33520497626869185443e-3, 6.05183413124413191178e-2, 5.27905102951428412248e-1, 1.87295284992346725209e0, 2.56852019228982242072e0, 1.0]


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def erfc(x) -> Column:
    """Complementary error function of a non-negative double (to about 1e-15)."""
    x = _col(x)
    near = F.lit(1.0) - x * _polynomial(x * x, _ERF_P) / _polynomial(x * x, _ERF_Q)
    middle = F.exp(-x * x) * _polynomial(x, _ERFC_P) / _polynomial(x, _ERFC_Q)
    y = F.lit(1.0) / (x * x)
    tail = F.exp(-x * x) / x * (F.lit(0.5641895835477562869) + y * _polynomial(y, _TAIL_P) / _polynomial(y, _TAIL_Q))
    return F.when(x <= 0.46875, near).when(x <= 4.0, middle).otherwise(tail)


def two_sided_p(z) -> Column:
    """Probability of a standard normal at least as far from 0 as ``z``."""
    return erfc(F.abs(_col(z)) / F.lit(2.0**0.5))
