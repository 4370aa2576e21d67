"""Scalar column expressions: parsing, casting, time features, tiers, risk factors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text formats of the two event feeds.
LIFECYCLE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.S] Z"
SIGNAL_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][.S]Z"
FLAG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.S]"
REFERENCE_ID_PATTERN = "#(.+?)##"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc(moment: datetime) -> Column:
    """A UTC moment as a zone-free literal: compares with both timestamp types and reaches the scan as a filter."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def extract_id(column: str | Column, pattern: str = REFERENCE_ID_PATTERN, group: int = 1) -> Column:
    """First match of ``pattern``, null when there is none."""
    return F.nullif(F.regexp_extract(_col(column), pattern, group), F.lit(""))


def parse_time(column: str | Column, fmt: str = LIFECYCLE_TIME_FORMAT) -> Column:
    """Parse text to a UTC timestamp; anything malformed becomes null."""
    return F.try_to_timestamp(_col(column).cast("string"), F.lit(fmt))


def try_cast(column: str | Column, kind: str) -> Column:
    """Cast that yields null instead of failing."""
    return _col(column).try_cast(kind)


def first_number(df: DataFrame, columns: Sequence[str]) -> Column:
    """First non-null number among the columns that exist; null double when none does."""
    present = [try_cast(F.col(f"`{c}`"), "double") for c in columns if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def lower_in(column: str | Column, values: Iterable[str]) -> Column:
    return F.lower(_col(column)).isin([v.lower() for v in values])


def time_features(ts: str | Column) -> dict[str, Column]:
    """Hour, weekday (Monday = 0), weekend, and business hours (Mon-Fri, 9 <= h < 17).

    One definition serves training and scoring alike.
    """
    ts = _col(ts)
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "event_hour": hour,
        "event_weekday": weekday,
        "event_is_weekend": (weekday >= 5).cast("tinyint"),
        "event_is_business_hours": ((weekday < 5) & (hour >= 9) & (hour < 17)).cast("tinyint"),
    }


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    angle = value.cast("double") * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def log_count(count: str | Column) -> Column:
    return F.log1p(_col(count).cast("double"))


def flag_bit(column: str | Column) -> Column:
    """Boolean to 0/1, null kept: a missing signal is not a negative one."""
    return _col(column).try_cast("boolean").cast("tinyint")


def coarse_geo(column: str | Column, places: int = 2) -> Column:
    """Round a coordinate so that only the neighbourhood remains (half to even)."""
    return F.bround(try_cast(column, "double"), places)


def flagged_label(flag: str | Column) -> Column:
    return _col(flag).isNotNull().cast("tinyint")


def clip(column: str | Column, lo: float, hi: float, default: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(_col(column), F.lit(default))))


def sum_of_flags(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)) for c in columns])


def any_flag(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)) for c in columns])


def finite(column: str | Column) -> Column:
    """Number with NaN, infinities, nulls and unparseable text replaced by zero."""
    number = try_cast(column, "double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def offer_prices(offer_type: str | Column, price: str | Column, net_share: float = 0.9) -> dict[str, Column]:
    """Split one price by offer type into buy, gross rent and net rent."""
    offer, price = F.upper(_col(offer_type)), _col(price)
    rent = F.when(offer == "RENT", price)
    return {"buy_price": F.when(offer == "BUY", price), "rent_gross": rent, "rent_net": rent * net_share}


def risk_tier(p: str | Column, high: float = 0.7, medium: float = 0.3) -> Column:
    p = _col(p)
    return F.when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")


def decision(p: str | Column, high: float = 0.7, medium: float = 0.3) -> Column:
    p = _col(p)
    return F.when(p >= high, "DECLINE").when(p >= medium, "REVIEW").otherwise("APPROVE")


def confidence(p: str | Column) -> Column:
    return F.round(F.abs(_col(p) - 0.5) * 2, 4)


# Boolean signal, factor name, impact.
SIGNAL_FACTORS = (
    ("tor", "tor_network", 0.25),
    ("vpn", "vpn_detected", 0.15),
    ("email_disposable", "disposable_email", 0.20),
    ("datacenter", "datacenter_ip", 0.15),
    ("proxy", "proxy_detected", 0.10),
)
# Link-count kind, factor name, smallest count that does not trigger, impact.
LINK_FACTORS = (("device", "shared_device", 5, 0.20), ("ip", "shared_ip", 10, 0.15))


def risk_factors(signals: dict[str, Column], links: dict[str, Column] | None = None, top: int = 5) -> Column:
    """The strongest rule-based reasons as an array of (impact, feature, value) structs, strongest first."""
    links = links or {}
    found = []
    for position, (signal, feature, impact) in enumerate(SIGNAL_FACTORS):
        if signal in signals:
            found.append((signals[signal], feature, F.lit("true"), impact, position))
    for position, (kind, feature, floor, impact) in enumerate(LINK_FACTORS, start=len(SIGNAL_FACTORS)):
        if kind in links:
            value = F.concat(links[kind].cast("string"), F.lit(" other listings"))
            found.append((links[kind] > floor, feature, value, impact, position))
    candidates = F.array(
        *[
            F.when(
                cond,
                F.struct(
                    F.lit(-impact).alias("rank"),
                    F.lit(position).alias("position"),
                    F.lit(feature).alias("feature"),
                    value.alias("value"),
                    F.lit(impact).alias("impact"),
                ),
            )
            for cond, feature, value, impact, position in found
        ]
    )
    ranked = F.slice(F.array_sort(F.filter(candidates, lambda x: x.isNotNull())), 1, top)
    return F.transform(ranked, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["impact"].alias("impact")))


# Upper edges and names of the probability bands.
PROBABILITY_BANDS = ((0.1, "0.0-0.1"), (0.3, "0.1-0.3"), (0.5, "0.3-0.5"), (0.7, "0.5-0.7"))
LAST_BAND = "0.7-1.0"


def probability_band(p: str | Column) -> Column:
    p = _col(p)
    chain = F
    for edge, name in PROBABILITY_BANDS:
        chain = chain.when(p < edge, name)
    return chain.otherwise(LAST_BAND)


def psi_label(psi: str | Column) -> Column:
    psi = _col(psi)
    return F.when(psi < 0.1, "STABLE").when(psi < 0.25, "MODERATE SHIFT").otherwise("SIGNIFICANT DRIFT")
