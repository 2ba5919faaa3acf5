"""Dates, distances, pay and other numbers as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.text import col

DAY_MS = 86_400_000
EARTH_KM = 6371.0
#: Periods in a working year.
PERIODS = {"year": 1.0, "month": 12.0, "week": 52.0, "day": 260.0, "hour": 2080.0}
#: US dollars of one unit of each currency, for ranking.
USD_PER_UNIT = {
    "USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CHF": 1.12, "CAD": 0.73, "AUD": 0.66, "NZD": 0.61, "SGD": 0.74, "HKD": 0.128, "JPY": 0.0067, "CNY": 0.14, "KRW": 0.00072, "INR": 0.012, "PKR": 0.0036, "BDT": 0.0083, "PHP": 0.0175, "IDR": 0.000062, "MYR": 0.22, "THB": 0.029, "VND": 0.00004, "AED": 0.272, "SAR": 0.267,
    "ILS": 0.27, "TRY": 0.03, "SEK": 0.095, "NOK": 0.093, "DKK": 0.145, "PLN": 0.25, "CZK": 0.043, "HUF": 0.0027, "RON": 0.22, "UAH": 0.024, "NGN": 0.00065, "GHS": 0.065, "KES": 0.0077, "ZAR": 0.054, "EGP": 0.02, "MAD": 0.1, "BRL": 0.18, "MXN": 0.055, "ARS": 0.001, "CLP": 0.0011, "COP": 0.00024, "PEN": 0.27,
}
#: Annual pay outside this range in dollars is bad data.
PLAUSIBLE_USD = (1_000.0, 5_000_000.0)
#: Order of levels; lead and manager are equal.
LEVELS = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "manager": 4, "director": 5, "executive": 6}


def lookup(table: dict, c: Column) -> Column:
    """A small literal table as an expression; null where the key isn't in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def datetime_ms(c: Column | str) -> Column:
    """Epoch milliseconds of RFC 3339 text, of date and time without zone (UTC), or of the date in the first ten characters; else null."""
    s = F.trim(col(c))
    zoned = F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(s))
    naive = F.try_to_timestamp(F.regexp_replace(s, "T", " "))
    day = F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd"))
    return F.unix_millis(F.coalesce(zoned, naive, day))


def bucket_ms(start: int, end: int, buckets: int) -> int:
    """Width of each of `buckets` time buckets, a second at least."""
    return max((end - start) // max(buckets, 1), 1000)


def bucket_start(ts: Column | str, start: Column | int, width: Column | int) -> Column:
    s, w = (x if isinstance(x, Column) else F.lit(x) for x in (start, width))
    return s + F.floor((col(ts) - s) / w) * w


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula; null with any null."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    # least() passes nulls over, so they are kept out of it
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def bbox(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) around a circle, clamped; a scan can push this predicate down, not the distance."""
    dlat = radius_km / 111.32
    dlon = radius_km / (111.32 * max(abs(math.cos(math.radians(lat))), 0.01))
    return max(lat - dlat, -90.0), min(lat + dlat, 90.0), max(lon - dlon, -180.0), min(lon + dlon, 180.0)


def annualize(amount: Column | str, period: Column | str) -> Column:
    """A year's amount; without a period under 1,000 is hourly and the rest annual; amounts of zero or less and unknown periods are null."""
    a, p = col(amount).cast("double"), col(period)
    factor = F.when(p.isNull(), F.when(a < 1000, F.lit(2080.0)).otherwise(F.lit(1.0))).otherwise(lookup(PERIODS, p))
    return F.when((a > 0) & ~F.isnan(a) & (a < float("inf")), a * factor)


def to_usd(amount: Column, currency: Column | str) -> Column:
    return amount * lookup(USD_PER_UNIT, F.upper(F.trim(col(currency))))


def normalized_pay(lo: Column | str, hi: Column | str, currency: Column | str, period: Column | str) -> Column:
    """Struct of annual_min, annual_max and usd_annual (the middle or the one side), the latter null outside the plausible range."""
    a, b = annualize(lo, period), annualize(hi, period)
    usd = to_usd(F.coalesce((a + b) / 2, a, b), currency)
    return F.struct(a.alias("annual_min"), b.alias("annual_max"), F.when(usd.between(*PLAUSIBLE_USD), usd).alias("usd_annual"))


def yield_points(hits: Column | str) -> Column:
    """Two points a hit, ten at most, none for negatives."""
    return F.least(F.greatest(col(hits), F.lit(0)) * 2, F.lit(10)).cast("double")


def per_second(before: Column, after: Column, ms: Column) -> Column:
    """Rate of a counter, never negative; null where no time passed."""
    return F.when(ms > 0, grown(after - before) / (ms / 1000.0))


def grown(change: Column) -> Column:
    """A counter's growth: nothing for a counter that fell back, null for an unknown one."""
    return F.when(change.isNotNull(), F.greatest(change, F.lit(0)))


def node_size(n: Column | str, base: float = 2.0) -> Column:
    """Display size that grows with the logarithm of a count."""
    return 1 + F.log(float(base), 1 + F.coalesce(col(n), F.lit(0)))


def seniority_gap(mine: Column | str, theirs: Column | str) -> Column:
    """1.0, 0.8, 0.35 or 0.1 for levels that are 0, 1, 2 or more apart; null for unknown levels."""
    gap = F.abs(lookup(LEVELS, col(mine)) - lookup(LEVELS, col(theirs)))
    return F.when(gap == 0, 1.0).when(gap == 1, 0.8).when(gap == 2, 0.35).when(gap > 2, 0.1)


def current_year(now_ms: int) -> int:
    """The year of a time, by mean years."""
    return 1970 + now_ms // 31_556_952_000


def shown_bytes(n: Column | str) -> Column:
    """A size as people read it."""
    v, out = col(n).cast("double"), None
    for limit, unit, places in ((1e3, "B", 0), (1e6, "kB", 1), (1e9, "MB", 1), (float("inf"), "GB", 1)):
        by = {"B": 1.0, "kB": 1e3, "MB": 1e6, "GB": 1e9}[unit]
        c = F.concat(F.format_number(v / by, places), F.lit(f" {unit}"))
        out = F.when(v < limit, c) if out is None else out.when(v < limit, c)
    return out
