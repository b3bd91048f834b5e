"""Timestamp texts of the logs, minute buckets and window keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
SPACE_FORM = "yyyy-MM-dd HH:mm:ss"
SLASH_FORM = "yyyy/MM/dd HH:mm:ss"
ACCESS_FORM = "dd/MMM/yyyy:HH:mm:ss xx"
MAIL_FORM = "dd MMM yyyy HH:mm:ss xx"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"

WINDOW_SECONDS = {"5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}


def window_seconds(keyword: str | None) -> int:
    """Length of a range keyword; unknown or empty means one hour."""
    return WINDOW_SECONDS.get((keyword or "").strip().lower(), 3600)


def _rfc3339(raw: Column) -> Column:
    return F.when(raw.rlike(RFC3339), raw.try_cast("timestamp"))


def parse_timestamp(raw: Column) -> Column:
    """First accepted form that fits, as TIMESTAMP; null when none does."""
    mail = F.regexp_replace(raw, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (?=\d\d )", "")
    return F.coalesce(
        _rfc3339(raw),
        F.try_to_timestamp(raw, F.lit(SPACE_FORM)),
        F.try_to_timestamp(raw, F.lit(SLASH_FORM)),
        F.try_to_timestamp(raw, F.lit(ACCESS_FORM)),
        F.when(mail != raw, F.try_to_timestamp(mail, F.lit(MAIL_FORM))),
    )


def normalise_audit_time(raw: Column, ingested_at: Column) -> Column:
    """Slash form becomes RFC 3339 UTC, other texts stay, an absent time is the ingestion time."""
    slash = F.try_to_timestamp(raw, F.lit(SLASH_FORM))
    return F.coalesce(F.date_format(slash, ISO_SECONDS), raw, F.date_format(ingested_at, ISO_SECONDS))


def minute_bucket(raw: Column, fallback: Column) -> Column:
    """Minute of an RFC 3339 text; anything else falls in the minute of ``fallback``."""
    return F.date_trunc("minute", F.coalesce(_rfc3339(raw), fallback))
