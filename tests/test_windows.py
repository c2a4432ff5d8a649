from datetime import date

import pytest

from pulseframe.plans import windows as W

TODAY = date(2024, 3, 15)


def test_presets_and_shift():
    r = W.preset_range("7d", TODAY)
    assert (r.start, r.end, r.days) == (date(2024, 3, 9), date(2024, 3, 16), 7)
    assert W.shift(r, -1).end == r.start
    half = W.preset_range("6m", TODAY)
    assert (half.start, half.end) == (date(2024, 1, 1), date(2024, 7, 1))
    assert W.shift(half, -1).start == date(2023, 7, 1)
    assert W.shift(W.preset_range("all", TODAY, date(2020, 1, 1)), 1) is None


def test_comparison_is_cut_to_elapsed_days():
    year = W.preset_range("1y", TODAY)
    assert W.elapsed_days(year, TODAY) == 75
    before = W.comparison(year, TODAY)
    assert (before.start, before.days) == (date(2023, 1, 1), 75)


def test_months_clamp_to_month_end():
    assert W.add_months(date(2024, 1, 31), 1) == date(2024, 2, 29)
    assert W.add_months(date(2024, 3, 31), -1) == date(2024, 2, 29)


def test_parse_window():
    assert W.parse_window({"from": "2024-01-01", "to": "2024-01-10"}, TODAY).days == 10
    assert W.parse_window({"from": "2024-02-30", "to": "2024-03-01"}, TODAY).days == 30
    assert W.parse_window({"p": "7d", "a": "2030-01-01"}, TODAY).end == date(2024, 3, 16)
    assert W.parse_window({"from": "2000-01-01", "to": "2024-01-10"}, TODAY).preset == "30d"


@pytest.mark.parametrize(("days", "want"), [(1, "minute"), (2, "minute"), (3, "hour"), (21, "hour"), (22, "day")])
def test_granularity(days, want):
    assert W.granularity(W.Range(date(2024, 1, 1), date.fromordinal(date(2024, 1, 1).toordinal() + days))) == want


def test_plan_and_small_rules():
    long, short = W.Range(date(2024, 1, 1), date(2024, 3, 1)), W.Range(date(2024, 1, 1), date(2024, 2, 1))
    assert W.source_plan(long, "sum") == "rollup" and W.source_plan(short, "sum") == "raw" and W.source_plan(long, "latest") == "raw" and W.source_plan(short, "sum", "rollup") == "rollup"
    assert [W.rolling_size("dashboard", n) for n in (900, 8, 40)] == [4, 2, 7]
    assert W.rolling_size("metric", 21) is None and W.rolling_size("explorer", 120) == 2
    assert [W.backoff_s(n) for n in (1, 2, 10)] == [30, 60, 1800]


def test_time_state_axes_and_months():
    assert W.time_query({"m": "x", "a": "2024-01-02", "p": "30d", "from": ""}) == "p=30d&a=2024-01-02"
    days = [date(2024, 1, d) for d in range(1, 11)]
    assert W.axis_labels(days, 4) == [days[0], days[3], days[6], days[9]]
    assert W.axis_labels(days[:2], 5) == days[:2] and W.axis_labels(days, 1) == [days[9]] and W.axis_labels([], 3) == []
    assert W.axis_bounds(1.0, 101.0) == (0.0, 109.0) and W.axis_bounds(-10.0, 90.0) == (-18.0, 98.0) and W.axis_bounds(5.0, 5.0) == (4.0, 6.0) and W.axis_bounds(None, None) is None
    assert [(r.start, r.end) for r in W.months(W.Range(date(2023, 12, 20), date(2024, 2, 3)))] == [(date(2023, 12, 20), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 2, 1)), (date(2024, 2, 1), date(2024, 2, 3))]
    assert W.range_label(W.Range(date(2024, 1, 1), date(2024, 1, 2))) == "1 Jan 2024"
