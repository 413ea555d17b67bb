"""Column expressions over panel rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.sources.panel import CAMPAIGN_CODES


def calendar(d: str = "date_key") -> dict[str, Column]:
    """Day of week (Monday 0) and month, month, ISO week, day of year, weekend, and their cycles."""
    base = {"dow": F.weekday(d), "dom": F.dayofmonth(d), "month": F.month(d), "week": F.weekofyear(d), "doy": F.dayofyear(d)}
    out = {**base, "weekend": (F.weekday(d) >= 5).cast("int")}
    for name, period in (("dow", 7), ("month", 12), ("doy", 365), ("week", 52)):
        out[f"{name}_sin"], out[f"{name}_cos"] = (f(base[name] * (2 * math.pi / period)) for f in (F.sin, F.cos))
    return out


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th such weekday (Monday 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


#: Events of a year, as dates of a year column.
EVENTS = {
    "black_friday": lambda y: nth_weekday(y, 11, 4, 4),
    "mothers_day": lambda y: nth_weekday(y, 5, 6, 2),
    "christmas": lambda y: F.make_date(y, F.lit(12), F.lit(25)),
    "new_year": lambda y: F.make_date(y, F.lit(1), F.lit(1)),
}


def event_distance(d: Column, event) -> Column:
    """Days to the nearest occurrence (negative: ahead of it), earlier years first among equals, within 60."""
    gaps = [F.datediff(d, event(F.year(d) + k)) for k in (-1, 0, 1)]
    near = F.when(F.abs(gaps[0]) <= F.least(F.abs(gaps[1]), F.abs(gaps[2])), gaps[0]).when(F.abs(gaps[1]) <= F.abs(gaps[2]), gaps[1]).otherwise(gaps[2])
    return F.greatest(F.lit(-60), F.least(F.lit(60), near))


def events(d: str = "date_key") -> dict[str, Column]:
    c, out = F.col(d), {}
    for name, event in EVENTS.items():
        gap = event_distance(c, event)
        out[f"{name}_days"], out[f"{name}_near"] = gap, F.exp(-F.abs(gap) / 14.0)
    out["black_friday_window"] = (F.abs(event_distance(c, EVENTS["black_friday"])) <= 4).cast("int")
    out["christmas_window"] = (F.abs(event_distance(c, EVENTS["christmas"])) <= 10).cast("int")
    md = F.date_format(c, "MM-dd")
    out["new_year_window"] = ((md >= "12-27") | (md <= "01-07")).cast("int")
    return out


def campaign_index(code: Column) -> Column:
    """Place in the fixed domain (none, then the codes); unknown and null: 0."""
    pairs = [x for i, k in enumerate(CAMPAIGN_CODES, 1) for x in (F.lit(k), F.lit(i))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(0))


def prices() -> dict[str, Column]:
    effective = {c: F.col("price") * (1 - F.col(f"discount_{c}") / 100) for c in ("web", "app")}
    return {
        "discount_max": F.greatest("discount_web", "discount_app"),
        "price_web": effective["web"],
        "price_app": effective["app"],
        "app_price_advantage": F.log1p(F.greatest(effective["web"], F.lit(0.0))) - F.log1p(F.greatest(effective["app"], F.lit(0.0))),
    }


def campaigns() -> dict[str, Column]:
    web, app = F.col("campaign_web") != -1, F.col("campaign_app") != -1
    disc = F.greatest("discount_web", "discount_app") > 0
    flags = {"web_active": web, "app_active": app, "any_active": web | app, "app_only": app & ~web, "same_subtype": web & (F.col("campaign_web") == F.col("campaign_app")), "discount_without_campaign": disc & ~(web | app), "app_discount_higher": F.col("discount_app") > F.col("discount_web")}
    return {k: v.cast("double") for k, v in flags.items()}


def known_event() -> Column:
    """Sale, a campaign or a discount on either channel."""
    return F.col("is_promo") | (F.col("campaign_web") != -1) | (F.col("campaign_app") != -1) | (F.col("discount_web") > 0) | (F.col("discount_app") > 0)


def price_relative(price: Column, ref: Column) -> Column:
    return F.coalesce(price / F.nullif(ref, F.lit(0.0)), F.lit(1.0))


def availability() -> dict[str, Column]:
    """Gap, observed, available, unavailable and the quantity of available days: three kinds of no demand."""
    observed = ~F.col("is_gap")
    available = observed & F.coalesce("available", F.lit(False))
    return {"observed": observed.cast("int"), "is_available": available.cast("int"), "is_unavailable": (observed & ~F.coalesce("available", F.lit(True))).cast("int"), "qty_available": F.when(available, F.col("quantity"))}


def finite(c: Column) -> Column:
    """Null where not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < math.inf), c)


def safe_log_ratio(a: Column, b: Column) -> Column:
    return F.when((finite(a) >= 0) & (finite(b) >= 0), F.log1p(a) - F.log1p(b))


def safe_expm1(x: Column, fallback: Column, cap: float | None = None) -> Column:
    """expm1 where it stays finite, else the fallback; at least 0, at most cap."""
    y = F.greatest(F.coalesce(F.when(finite(x) <= math.log(1.7976931348623157e308) - 2, F.expm1(x)), fallback), F.lit(0.0))
    return y if cap is None else F.least(y, F.lit(float(cap)))


def app_share(app: Column, total: Column, smoothing: float = 1.0) -> tuple[Column, Column]:
    """(share, mask): smoothed share of the app; 0.5 and no mask where undefined."""
    ok = F.coalesce((finite(app) >= 0) & (finite(total) > 0) & (app <= total), F.lit(False))
    return F.when(ok, (app + smoothing) / (total + 2 * smoothing)).otherwise(0.5), ok


def submission(x: Column) -> Column:
    """Non-negative, rounded half to even."""
    return F.when(x.isNotNull(), F.rint(F.greatest(x, F.lit(0.0))).cast("int"))


def stratum(origin: Column, days: int = 7) -> Column:
    """winter: all target days in January or February; holiday: any from November 20 to the year's end; else regular."""
    target = F.sequence(F.date_add(origin, 1), F.date_add(origin, days))
    winter = F.forall(target, lambda d: F.month(d) <= 2)
    holiday = F.exists(target, lambda d: (F.month(d) == 12) | ((F.month(d) == 11) & (F.dayofmonth(d) >= 20)))
    return F.when(winter, "winter").when(holiday, "holiday").otherwise("regular")


def context_calendar(date: str = "date_key") -> dict[str, Column]:
    """The weekday's and the month's place on their cycles."""
    weekday, month = F.weekday(date) * (2 * math.pi / 7), F.month(date) * (2 * math.pi / 12)
    return {"weekday_sin": F.sin(weekday), "weekday_cos": F.cos(weekday), "month_sin": F.sin(month), "month_cos": F.cos(month)}


def canonical(c: Column) -> Column:
    """A category as text: whole numbers without decimals, booleans as true or false, null as 'missing'."""
    number = c.try_cast("double")
    return F.coalesce(F.when(number.isNotNull() & (number == F.floor(number)) & c.try_cast("boolean").isNull(), number.cast("long").cast("string")).otherwise(c.cast("string")), F.lit("missing"))


def candidate_id(config: Column) -> Column:
    return F.substring(F.sha2(F.to_json(config), 256), 1, 12)


def scored(actual: str, predictions: list[str]) -> Column:
    """Available, with a finite actual and all predictions finite."""
    return reduce(lambda a, b: a & b, [F.coalesce("available", F.lit(False)), *[finite(F.col(c)).isNotNull() for c in (actual, *predictions)]])


def weighted_present(pairs: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the values that are there; null if none is."""
    num = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.when(den > 0, num / den)
