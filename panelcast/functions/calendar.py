"""Calendar arithmetic on naive local timestamps (``timestamp_ntz``).

Every expression is independent of the session time zone: a grid position is
the whole number of days or hours since 1970-01-01 of the wall clock, so lags,
windows, folds and phases become integer arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import FORECAST_HOURS, FORECAST_WEEKDAYS, LOCAL_ZONE

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_days(ts: str | Column) -> Column:
    return F.unix_date(F.to_date(_c(ts))).cast("long")


def epoch_hours(ts: str | Column) -> Column:
    return epoch_days(ts) * 24 + F.hour(_c(ts))


def epoch_seconds(ts: str | Column) -> Column:
    ts = _c(ts)
    return epoch_hours(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: str | Column) -> Column:
    ts = _c(ts)
    second = F.extract(F.lit("SECOND"), ts)  # decimal(8,6): keeps microseconds
    return (epoch_hours(ts) * 60 + F.minute(ts)) * 60000000 + (second * 1000000).cast("long")


def from_seconds(seconds: Column) -> Column:
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


@dataclass(frozen=True)
class Freq:
    """A calendar grid: ``D`` (days) or ``h`` (hours)."""

    code: str

    def __post_init__(self) -> None:
        if self.code not in ("D", "h"):
            raise ValueError(f"only 'D' and 'h' are supported, got {self.code!r}")

    @property
    def per_day(self) -> int:
        return 1 if self.code == "D" else 24

    @property
    def period(self) -> int:
        """Steps in the weekly cycle."""
        return 7 * self.per_day

    @property
    def seconds(self) -> int:
        return 86400 // self.per_day

    def pos(self, ts: str | Column) -> Column:
        """Grid position of a timestamp (floored to the grid)."""
        return epoch_days(ts) if self.code == "D" else epoch_hours(ts)

    def at(self, pos: str | Column) -> Column:
        """Timestamp of a grid position."""
        return from_seconds(_c(pos) * self.seconds)

    def on_grid(self, ts: str | Column) -> Column:
        return epoch_micros(ts) == self.pos(ts) * (self.seconds * 1000000)

    def phase(self, pos: str | Column) -> Column:
        """Same weekday (and hour, on an hourly grid): 0 .. period-1."""
        return F.pmod(_c(pos), F.lit(self.period))

    def floor(self, ts: str | Column) -> Column:
        return self.at(self.pos(ts))


DAILY = Freq("D")
HOURLY = Freq("h")


# --- parts and encodings -----------------------------------------------------

PERIODS = {"dayofweek": 7, "month": 12, "hour": 24, "day": 31, "quarter": 4}


def part(ts: str | Column, name: str) -> Column:
    """A calendar part as int; ``dayofweek`` and ``weekday`` count Monday as 0."""
    ts = _c(ts)
    parts = {
        "dayofweek": F.weekday,
        "weekday": F.weekday,
        "month": F.month,
        "hour": F.hour,
        "day": F.dayofmonth,
        "quarter": F.quarter,
        "year": F.year,
    }
    return parts[name](ts).cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def seasonal_parts(freq: Freq) -> list[str]:
    return ["dayofweek", "month"] + (["hour"] if freq.code == "h" else [])


def is_weekend(ts: str | Column) -> Column:
    return (F.weekday(_c(ts)) > 4).cast("int")


def seasonal_names(freq: Freq, cyclical: bool = True, weekend: bool = True) -> list[str]:
    parts = seasonal_parts(freq)
    names = [f"{p}_{f}" for p in parts for f in ("sin", "cos")] if cyclical else list(parts)
    return names + ["is_weekend"] * weekend


def seasonal_columns(
    ts: str | Column, freq: Freq, cyclical: bool = True, weekend: bool = True
) -> dict[str, Column]:
    """Sine/cosine pairs (or plain codes) per calendar part, and a weekend flag."""
    out: dict[str, Column] = {}
    for name in seasonal_parts(freq):
        if cyclical:
            out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(part(ts, name), PERIODS[name])
        else:
            out[name] = part(ts, name)
    if weekend:
        out["is_weekend"] = is_weekend(ts)
    return out


def cyclic_encoder(ts: str | Column, parts: list[tuple[str, int]]) -> dict[str, Column]:
    """Sine/cosine pairs for any list of (part, period)."""
    out: dict[str, Column] = {}
    for name, period in parts:
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(part(ts, name), period)
    return out


# --- forecast calendar ---------------------------------------------------------


def hours_until_midnight(ts: str | Column, zone: str | None = None) -> Column:
    """Whole hours left until the next midnight.

    ``ts`` is naive; with ``zone`` it is UTC wall time and the hours elapsed
    until midnight in that zone are counted, clock changes included.
    """
    ts = _c(ts)
    if zone is None:
        left = (epoch_days(ts) + 1) * 86400 - epoch_seconds(ts)
    else:
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
        midnight = from_seconds((epoch_days(local) + 1) * 86400)
        back = F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)
        left = epoch_seconds(back) - epoch_seconds(ts)
    return F.floor(left / 3600).cast("int")


def next_wednesday(ts: str | Column) -> Column:
    """Same time of day, floored to the hour, on the next Wednesday (or today)."""
    ts = _c(ts)
    days = F.pmod(F.lit(2) - F.weekday(ts), F.lit(7))
    return HOURLY.at(epoch_hours(ts) + days * 24)


def forecast_hours(start: str | Column, days: int = 5) -> Column:
    """Array of grid hours in ``[start, start + days]`` on Friday and Saturday noon,
    afternoon and evening."""
    first = epoch_hours(start)
    hours = F.sequence(first, first + days * 24)
    keep = F.filter(
        hours,
        lambda h: F.pmod(h, F.lit(24)).isin(*FORECAST_HOURS)
        # position 0 is Thursday, 1970-01-01: weekday 3 when Monday counts as 0
        & F.pmod(F.floor(h / 24) + 3, F.lit(7)).isin(*FORECAST_WEEKDAYS),
    )
    return F.transform(keep, lambda h: HOURLY.at(h))


def following_days(start: str | Column, periods: int = 7) -> Column:
    """Array of the days after ``start``: a range of ``periods`` days, left end dropped."""
    first = epoch_days(start)
    return F.transform(F.sequence(first + 1, first + periods - 1), lambda d: DAILY.at(d))


# --- time zones ----------------------------------------------------------------


def to_local(ts_utc: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall time to local wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts_utc))


def to_utc(ts_local: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Local wall time to UTC; an ambiguous hour takes the earlier instant."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _c(ts_local))


# --- holidays --------------------------------------------------------------------

# Public holidays in Baden-Wuerttemberg, as (month, day) and as
# days from Easter Sunday; 31 October was a holiday once, in 2017.
FIXED_HOLIDAYS = ((1, 1), (1, 6), (5, 1), (10, 3), (11, 1), (12, 25), (12, 26))
EASTER_OFFSETS = (-2, 1, 39, 50, 60)


def easter_sunday(year: Column) -> Column:
    """Easter Sunday by the Gregorian computus (Meeus, Astronomical Algorithms)."""

    def div(a: Column, n: int) -> Column:
        return F.floor(a / n)

    century, rest = div(year, 100), year % 100
    golden = year % 19
    epact = (
        golden * 19 + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15
    ) % 30
    weekday = ((century % 4) * 2 + div(rest, 4) * 2 + 32 - epact - rest % 4) % 7
    shift = div(golden + epact * 11 + weekday * 22, 451)
    march = epact + weekday - shift * 7 + 114
    return F.make_date(year, div(march, 31).cast("int"), (march % 31 + 1).cast("int"))


def is_holiday(ts: str | Column) -> Column:
    """Holiday flag of a day, computed in place: no join, no shuffle."""
    day = F.to_date(_c(ts))
    md = F.month(day) * 100 + F.dayofmonth(day)
    fixed = md.isin(*[m * 100 + d for m, d in FIXED_HOLIDAYS])
    moving = F.datediff(day, easter_sunday(F.year(day))).isin(*EASTER_OFFSETS)
    return fixed | moving | (day == F.lit("2017-10-31").cast("date"))


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """The holiday dimension: at most 13 rows per year."""
    days = spark.range(0, 1).select(
        F.explode(
            F.sequence(
                F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
                F.make_date(F.lit(last_year), F.lit(12), F.lit(31)),
            )
        ).alias("day")
    )
    return days.filter(is_holiday("day"))
