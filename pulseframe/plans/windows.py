"""Windows of local days, comparisons, granularity and the choice between rollup and raw rows."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import urlencode

#: Presets, the longest custom window, and the bounds of each granularity in days.
ROLLING = {"24h": 1, "7d": 7, "30d": 30}
MONTHS = {"6m": 6, "1y": 12}
LONGEST, MINUTE_DAYS, HOUR_DAYS, ROLLUP_DAYS = 5490, 2, 21, 31


@dataclass(frozen=True)
class Range:
    """Half-open local days [start, end)."""

    start: date
    end: date
    preset: str | None = None

    @property
    def days(self) -> int:
        return (self.end - self.start).days


def add_months(d: date, n: int) -> date:
    """The same day of another month, or its last day."""
    m = d.year * 12 + d.month - 1 + n
    y, m = divmod(m, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def parse_day(s: str | None) -> date | None:
    """A real calendar day written YYYY-MM-DD, else None."""
    try:
        return date.fromisoformat(s) if s and len(s) == 10 else None
    except ValueError:
        return None


def inclusive(first: date, last: date) -> Range:
    return Range(first, last + timedelta(days=1))


def preset_range(preset: str, anchor: date, first_day: date | None = None) -> Range:
    """Rolling days that end with the anchor; six calendar months or a calendar year around it; or all
    days from the first."""
    if preset in ROLLING:
        end = anchor + timedelta(days=1)
        return Range(end - timedelta(days=ROLLING[preset]), end, preset)
    if preset == "6m":
        start = anchor.replace(month=1 if anchor.month <= 6 else 7, day=1)
        return Range(start, add_months(start, 6), preset)
    if preset == "1y":
        return Range(date(anchor.year, 1, 1), date(anchor.year + 1, 1, 1), preset)
    if preset == "all":
        return Range(first_day or anchor, anchor + timedelta(days=1), preset)
    raise ValueError(f"no preset {preset!r}")


def shift(r: Range, steps: int) -> Range | None:
    """The window moved by whole lengths, or calendar months; None for all."""
    if r.preset == "all":
        return None
    if r.preset in MONTHS:
        n = MONTHS[r.preset] * steps
        return Range(add_months(r.start, n), add_months(r.end, n), r.preset)
    d = timedelta(days=r.days * steps)
    return Range(r.start + d, r.end + d, r.preset)


def elapsed_days(r: Range, today: date) -> int:
    return max(1, min(r.days, (today - r.start).days + 1))


def comparison(r: Range, today: date) -> Range | None:
    """The window before, cut to the days that have passed of this one."""
    before = shift(r, -1)
    if before is None:
        return None
    n = elapsed_days(r, today)
    return before if n >= r.days else Range(before.start, before.start + timedelta(days=min(n, before.days)), r.preset)


def parse_window(params: dict, today: date, first_day: date | None = None) -> Range:
    """A custom inclusive window of at most LONGEST days, else a preset (30d) at a clamped anchor."""
    a, b = parse_day(params.get("from")), parse_day(params.get("to"))
    if a and b and a <= b and (b - a).days + 1 <= LONGEST:
        return inclusive(a, b)
    preset = params.get("p") if params.get("p") in {*ROLLING, *MONTHS, "all"} else "30d"
    anchor = min(parse_day(params.get("a")) or today, today)
    return preset_range(preset, anchor, first_day)


def granularity(r: Range) -> str:
    return "minute" if r.days <= MINUTE_DAYS else "hour" if r.days <= HOUR_DAYS else "day"


def source_plan(r: Range, aggregation: str, forced: str | None = None) -> str:
    """rollup for long windows of sums and averages, else raw rows. Both give the same numbers."""
    if forced in ("raw", "rollup"):
        return forced
    return "rollup" if r.days > ROLLUP_DAYS and aggregation in ("sum", "average") else "raw"


def rolling_size(kind: str, n: int) -> int | None:
    """Points of the rolling mean by page; None for none."""
    half_up = lambda x: int(x + 0.5)
    if kind == "dashboard":
        return 4 if n > 800 else max(2, min(7, n // 4))
    if kind == "metric":
        return None if n <= 21 else max(2, min(14, half_up(n / 12)))
    if kind == "explorer":
        return None if n <= 90 else max(2, half_up(n / 60))
    raise ValueError(kind)


def backoff_s(attempt: int) -> int:
    return min(30 * 2 ** (attempt - 1), 1800)


def timeline_window(r: Range, today: date) -> Range:
    end = min(r.end, today + timedelta(days=1))
    return Range(end - timedelta(days=30), end)


#: The parameters that make up the time state of a request, in their order.
TIME_KEYS = ("p", "a", "from", "to", "compare")


def time_query(params: dict[str, str]) -> str:
    """The time state of a request as a query, without its other parameters or empty ones."""
    return urlencode([(k, params[k]) for k in TIME_KEYS if params.get(k)])


def axis_labels(days: list[date], slots: int) -> list[date]:
    """At most ``slots`` different days, evenly apart from the first to the last; of one slot the last."""
    count = min(slots, len(days))
    if count < 1:
        return []
    last = len(days) - 1
    at = [last] if count == 1 else [int(i / (count - 1) * last + 0.5) for i in range(count)]
    return [days[i] for i in dict.fromkeys(at)]


def axis_bounds(low: float | None, high: float | None, share: float = 0.08) -> tuple[float, float] | None:
    """The ends of an axis with room at both, never under zero where no value is; one apart for one value."""
    if low is None or high is None:
        return None
    if low == high:
        return low - 1, high + 1
    room = (high - low) * share
    return (max(0.0, low - room) if low >= 0 else low - room), high + room


def range_label(r: Range) -> str:
    """A window's first and last day, or the one there is."""
    last = r.end - timedelta(days=1)
    text = lambda d: f"{d.day} {d:%b %Y}"
    return text(r.start) if r.start == last else f"{text(r.start)} - {text(last)}"


def month_start(d: date) -> date:
    return d.replace(day=1)


def next_month(d: date) -> date:
    return add_months(month_start(d), 1)


def months(r: Range) -> list[Range]:
    """A window cut at the starts of months, for rebuilds month by month."""
    out, at = [], r.start
    while at < r.end:
        end = min(next_month(at), r.end)
        out.append(Range(at, end))
        at = end
    return out
