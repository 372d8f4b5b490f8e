"""Presentation strings of results: ages, money, dates, badge and popover lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echofold.model import HOUR_MS


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def format_age(ms: Column, zero: str | None = None) -> Column:
    hours = ms / HOUR_MS
    text = F.when(hours < 1, F.concat(F.greatest(F.lit(1), F.floor(ms / 60_000 + 0.5)).cast("long").cast("string"), F.lit(" min")))
    text = text.when(hours < 48, F.concat(_round(hours), F.lit(" h"))).otherwise(F.concat(_round(hours / 24), F.lit(" days")))
    return text if zero is None else F.when(ms == 0, zero).otherwise(text)


def format_usd(value: Column) -> Column:
    text = F.when(value >= 1e9, F.format_string("$%.2fB", value / 1e9)).when(value >= 1e6, F.format_string("$%.2fM", value / 1e6))
    return text.when(value >= 1e3, F.format_string("$%.1fK", value / 1e3)).when(value.isNotNull(), F.concat(F.lit("$"), _round(value)))


def format_date(ms: Column) -> Column:
    """The UTC date, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")


def describe_run(evidence: Column) -> Column:
    return F.when(evidence == "migrated", "ran — migrated").when(evidence == "market-cap", "ran — peak MC").otherwise("no run observed")


def describe_image(distance: Column) -> Column:
    return F.when(distance == 0, "identical image").when(distance.isNotNull(), F.concat(F.lit("image "), distance.cast("string"), F.lit("/64 bits apart")))


def badge(ran: Column, total: Column, capped: Column, confident: Column, age_ms: Column) -> Column:
    count = F.concat(ran.cast("string"), F.lit(" / "), total.cast("string"), F.when(capped, "+").otherwise(""))
    return F.when(confident, count).otherwise(F.concat(F.lit("new corpus · "), format_age(age_ms)))


def prior_line(name: Column, first_seen: Column, peak: Column, evidence: Column, matched_on: Column, distance: Column) -> Column:
    peak_text = F.coalesce(F.concat(F.lit("peak MC "), format_usd(peak)), F.lit("peak MC unknown"))
    return F.concat_ws(" · ", F.coalesce(name, F.lit("(no name)")), F.concat(F.lit("first seen "), format_date(first_seen)), peak_text, describe_run(evidence), F.concat(F.lit("recognised by "), F.array_join(matched_on, " + ")), describe_image(distance))


def describe_rejections(reasons: dict[str, Column], rejected: Column) -> Column:
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + reason.replace("-", " ")))) for reason, n in reasons.items()]
    return F.when(rejected == 0, "").otherwise(F.concat(F.lit(" ("), rejected.cast("string"), F.lit(" skipped: "), F.concat_ws(", ", *parts), F.lit(")")))
