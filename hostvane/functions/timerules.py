"""Bucket widths and period windows, resolved on the driver before a plan is built."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

HOUR = 3600
DAY = 86400

# Bucket names and widths in seconds.
BUCKETS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400, "7d": 604800}

# Longest range in seconds served by each automatic width, and the widest one.
AUTO_WIDTHS = ((6 * HOUR, 300), (2 * DAY, 3600), (30 * DAY, 21600), (180 * DAY, 86400))
WIDEST = 604800
DEFAULT_WIDTH = 3600

_ISO_SECONDS = re.compile(r"\s*(\d{1,4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})")


def parse_iso(text: str | None) -> datetime | None:
    """``YYYY-MM-DDTHH:MM:SS`` as UTC; a trailing ``Z`` or fraction is ignored; bad input gives None."""
    found = _ISO_SECONDS.match(text or "")
    if not found:
        return None
    try:
        return datetime(*(int(g) for g in found.groups()))
    except ValueError:
        return None


def format_iso(moment: datetime) -> str:
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def previous_period(start: str | None, end: str | None) -> tuple[str, str] | None:
    """The window of equal length that ends where this one starts."""
    first, last = parse_iso(start), parse_iso(end)
    if first is None or last is None or last <= first:
        return None
    return format_iso(first - (last - first)), format_iso(first)


def auto_bucket_seconds(start: str | None, end: str | None) -> int:
    first, last = parse_iso(start), parse_iso(end)
    if first is None or last is None:
        return DEFAULT_WIDTH
    span: timedelta = last - first
    return next((w for limit, w in AUTO_WIDTHS if span.total_seconds() <= limit), WIDEST)


def bucket_seconds(name: str | None, start: str | None = None, end: str | None = None) -> int:
    if name in (None, "", "auto"):
        return auto_bucket_seconds(start, end)
    return BUCKETS.get(name, DEFAULT_WIDTH)


def bucket_label(seconds: int) -> str:
    # Only the widths the automatic rule can pick have a short name.
    named = {300: "5m", 3600: "1h", 21600: "6h", 86400: "1d", 604800: "7d"}
    return named.get(seconds, f"{seconds}s")
