"""Durations as whole nanoseconds, and how they are written."""

from __future__ import annotations

import re
from datetime import timedelta

UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def ns(duration: int | str | timedelta) -> int:
    """Nanoseconds of 90, '1h30m', '250ms' or a timedelta."""
    if isinstance(duration, timedelta):
        return (duration.days * 86400 + duration.seconds) * 10**9 + duration.microseconds * 1000
    if isinstance(duration, int):
        return duration
    sign, text = (-1, duration[1:]) if duration.startswith("-") else (1, duration)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {duration!r}")
    return sign * round(sum(float(a) * UNITS[b] for a, b in parts))


def written(d: int | None) -> str:
    """1h0m0s, 1m30s, 1.5s, 250ms, 0s; None is NaDuration."""
    if d is None:
        return "NaDuration"
    sign, d = ("-", -d) if d < 0 else ("", d)
    plain = lambda x, unit: f"{x / UNITS[unit]:.9f}".rstrip("0").rstrip(".") + unit
    if d == 0:
        return "0s"
    for unit, most in (("ns", 10**3), ("µs", 10**6), ("ms", 10**9)):
        if d < most:
            return sign + plain(d, unit)
    hours, rest = divmod(d, UNITS["h"])
    minutes, rest = divmod(rest, UNITS["m"])
    out = (f"{hours}h" if hours else "") + (f"{minutes}m" if hours or minutes else "")
    whole, part = divmod(rest, 10**9)
    return sign + out + (f"{whole}.{part:09d}".rstrip("0") if part else str(whole)) + "s"
