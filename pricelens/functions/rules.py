"""Small rules of the model, as column expressions."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .price_text import WHITE

# The sites whose posts are of new products; hours that Korean time is ahead.
NEW_SITES, KST_HOURS = ("ppomppu", "ruliweb", "fmkorea"), 9
BOARD_FLOOR_S, MARKET_FLOOR_S = 60, 600
#: A board's times: the word before them, a time of day, a date.
DATE_MARK = re.compile(r"^[ \t\n\x0b\f\r]*날짜[ \t\n\x0b\f\r]*")
CLOCK, DAY = re.compile(r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"), re.compile(r"([0-9]{4}|[0-9]{2})[/.]([0-9]{1,2})[/.]([0-9]{1,2})")
EPOCH = dt.date(1970, 1, 1).toordinal()
TOLD = T.StructType([T.StructField("clock", T.IntegerType()), T.StructField("day", T.IntegerType())])


def allowed_site(site: Column) -> Column:
    """Whether a site's posts are taken; false for null."""
    return F.coalesce(F.lower(F.trim(site)).isin(*NEW_SITES), F.lit(False))


def keyword_verdict(title: Column, keywords: Column, label: Column) -> Column:
    """CLEAN, or EXCLUDED - LABELED where label says that hits are only marked - for a title that holds a keyword."""
    hit = F.coalesce(F.exists(keywords, lambda k: title.contains(k)), F.lit(False))
    return F.when(~hit, "CLEAN").when(label, "LABELED").otherwise("EXCLUDED")


def normalized_keywords(keywords: Column) -> Column:
    """Trimmed, without empty ones, each once in the order of its first; empty for null."""
    trimmed = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k.isNotNull() & (k != ""))
    return F.coalesce(F.array_distinct(trimmed), F.array().cast("array<string>"))


def keyword_setting(json: Column) -> Column:
    """A setting's JSON list of strings; empty where it is none."""
    parsed = F.from_json(json, "array<string>", {"mode": "PERMISSIVE"})
    return normalized_keywords(F.when(F.trim(json).startswith("["), parsed))


def needs_detail(price: Column, title: Column, aliases: Column) -> Column:
    """Whether a post's own page is worth a look: no price, a title cut short, and an alias (without spaces) in it."""
    plain = F.replace(title, F.lit(" "), F.lit(""))
    return F.coalesce(price.isNull() & title.endswith("...") & F.exists(aliases, lambda a: plain.contains(F.replace(a, F.lit(" "), F.lit("")))), F.lit(False))


def policy_errors(period: Column, k: Column, target: Column, start: Column, end: Column) -> Column:
    """What is wrong with an alert policy, in this order; empty for a good one."""
    hour = lambda h: h.isNull() | h.between(0, 23)
    return F.array_compact(F.array(
        F.when(F.coalesce(period <= 0, F.lit(True)), "period"), F.when(~F.coalesce(k.between(3, 10), F.lit(False)), "k_display"), F.when(target <= 0, "target"),
        F.when(start.isNull() != end.isNull(), "quiet_hours"), F.when(~(hour(start) & hour(end)), "hour"),
    ))


def registration_errors(name: Column, mode: Column, variants: Column) -> Column:
    """What is wrong with a product to be registered; empty for a good one."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(name) == "", F.lit(True)), "name"), F.when(~F.coalesce(mode.isin("GROUPED", "SPLIT"), F.lit(False)), "mode"), F.when(F.coalesce(F.size(variants) < 1, F.lit(True)), "variants"),
    ))


def variant_labels(axes: list[Column]) -> Column:
    """Every combination of the axes' values (arrays), in order, as labels joined by " / "."""
    out = axes[0]
    for a in axes[1:]:
        out = F.flatten(F.transform(out, lambda left: F.transform(a, lambda right: F.concat(left, F.lit(" / "), right))))  # noqa: B023  called at once
    return out


def split_list(text: Column) -> Column:
    """Parts between commas and line ends: trimmed, none empty, each once."""
    return normalized_keywords(F.split(text, r"[,\n]"))


def time_told(text: str | None) -> tuple[int | None, int | None]:
    """What a board's time says: seconds of a day, 21:10 or 21:10:11, or days since 1970, 26/07/03 or 2026.07.03; none of all else. 60 seconds are no time here."""
    t = DATE_MARK.sub("", text or "", count=1).strip(WHITE)
    if m := CLOCK.fullmatch(t):
        h, minute, s = (int(x or 0) for x in m.groups())
        return (h * 3600 + minute * 60 + s, None) if h < 24 and minute < 60 and s < 60 else (None, None)
    if m := DAY.fullmatch(t):
        y, month, d = map(int, m.groups())
        try:
            return None, dt.date(y + 2000 if y < 100 else y, month, d).toordinal() - EPOCH
        except ValueError:
            return None, None
    return None, None


@F.arrow_udf(TOLD)
def told_times(text: pa.Array) -> pa.Array:
    told = [time_told(t) for t in text.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([x[i] for x in told], pa.int32()) for i in (0, 1)], ["clock", "day"])


def time_at(clock: Column, day: Column, now: Column) -> Column:
    """A time told by time_told as UTC, with now in UTC: of today's Korean date - yesterday's if that is more than 12 hours ahead - or the end of a day; null for neither."""
    ahead = F.make_dt_interval(F.lit(0), F.lit(KST_HOURS))
    midnight = (now + ahead).cast("date").cast("timestamp_ntz") - ahead
    at = midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), clock.cast("decimal(18,6)"))
    at = F.when(at > now + F.make_dt_interval(F.lit(0), F.lit(12)), at - F.make_dt_interval(F.lit(1))).otherwise(at)
    return F.coalesce(at, F.date_from_unix_date(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59)) - ahead)


def board_time(text: Column, now: Column) -> Column:
    """A board's time as UTC: what time_told finds, as time_at has it."""
    told = told_times(text)
    return time_at(told["clock"], told["day"], now)


def korean_date(ts: Column) -> Column:
    """The date in Korea of a UTC time."""
    return (ts + F.make_dt_interval(F.lit(0), F.lit(KST_HOURS))).cast("date")


def gauge(value: Column, others: list[Column]) -> Column:
    """Where value stands between the least and the greatest of all, 8 percent of room at both ends (10 percent of the value where all are one), from 0 to 100; null for null, and where all are 0."""
    low, high = F.least(value, *others), F.greatest(value, *others)
    room = F.when(high > low, (high - low) * 0.08).otherwise(F.abs(value) * 0.1)
    at = F.try_divide((value - low + room) * 100.0, high - low + 2 * room)
    return F.when(at.isNotNull(), F.least(F.greatest(at, F.lit(0.0)), F.lit(100.0)))


def poll_interval(configured: Column, market: Column) -> Column:
    """Seconds between polls: no less than the floor of boards or of markets."""
    return F.greatest(configured, F.when(market, MARKET_FLOOR_S).otherwise(BOARD_FLOOR_S))


def backoff(failures: Column, base: int = 60, factor: float = 2.0, cap: int = 1800) -> Column:
    """Seconds to wait after failures in a row; 0 for none."""
    return F.when(failures < 1, 0).otherwise(F.least(F.lit(float(cap)), base * F.pow(F.lit(factor), failures - 1))).cast("long")


def http_outcome(status: Column) -> Column:
    return F.when(status.isin(403, 429), "BLOCKED").when(status.between(200, 299), "OK").otherwise("TRANSIENT")


def market_url(platform: Column, keywords: Column, listings: int = 100) -> Column:
    """The address that a second-hand search is polled at; an unknown platform is an error."""
    q = F.replace(F.url_encode(F.array_join(keywords, " ")), F.lit("+"), F.lit("%20"))
    known = F.concat(F.lit("https://api.bunjang.co.kr/api/1/find_v2.json?q="), q, F.lit(f"&n={listings}"))
    return F.when(platform == "BUNJANG", known).otherwise(F.raise_error(F.concat(F.lit("unknown platform: "), F.coalesce(platform, F.lit("null")))).cast("string"))


def post_status(raw: Column) -> Column:
    """A deal's status by its post's: over where that is sold out or deleted."""
    return F.when(F.coalesce(raw.isin("SOLD_OUT", "DELETED"), F.lit(False)), "ENDED").otherwise("ACTIVE")


def repriced(deal: Column, price: Column) -> Column:
    """A deal (price_min, price_max, price_last, status) after a new price; a deal that is over is an error."""
    checked = F.when(deal["status"] == "ENDED", F.raise_error(F.lit("the deal is over")).cast("long")).otherwise(price)
    return F.struct(F.least(deal["price_min"], checked).alias("price_min"), F.greatest(deal["price_max"], checked).alias("price_max"), checked.alias("price_last"), deal["status"].alias("status"))
