"""Interval and timestamp literals, in milliseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from eventlake.errors import ParseError
from eventlake.plans.lexer import Token, unquote

#: Units of intervals.
_UNITS = {"ms": 1, "millisecond": 1, "milliseconds": 1, "s": 1000, "sec": 1000, "secs": 1000, "second": 1000, "seconds": 1000,
          "m": 60_000, "min": 60_000, "mins": 60_000, "minute": 60_000, "minutes": 60_000, "h": 3_600_000, "hr": 3_600_000, "hrs": 3_600_000,
          "hour": 3_600_000, "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000}


def text_ms(text: str) -> int:
    """'5 minutes', '30s', '250' (milliseconds)."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m:
        raise ParseError(f"no interval: {text!r}")
    unit = m.group(2).lower()
    if unit and unit not in _UNITS:
        raise ParseError(f"no unit of time: {unit!r}")
    return int(m.group(1)) * _UNITS.get(unit, 1)


def interval_ms(tokens: list[Token]) -> int:
    """INTERVAL '5 minutes', INTERVAL '1' HOUR, INTERVAL 5 MINUTES, '5 minutes' or a number of milliseconds."""
    rest = tokens[1:] if tokens and tokens[0].word == "INTERVAL" else tokens
    if not rest or rest[0].kind not in ("string", "number") or len(rest) > 2:
        raise ParseError("an interval is expected")
    return text_ms(" ".join(unquote(t) for t in rest))


def timestamp_ms(text: str) -> int | None:
    """Milliseconds of an RFC 3339 time or a date, None if it is none."""
    try:
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
