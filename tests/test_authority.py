"""Device authority as a stream's state against a plain version that takes the minutes one after the other."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd

from pulseframe.streaming import authority

FIELDS = "subject_id long, type string, minute_ts timestamp, device_id long, value double, batch string, place int"
FROM = datetime(2024, 1, 10, tzinfo=timezone.utc)


def plain(batches):
    owners, held, quarantined, out = {}, {}, set(), []
    for rows in batches:
        rows = sorted((r for r in rows if None not in r[:5]), key=lambda r: (r[5], r[6]))
        last = {(s, t, b, d, m): p for s, t, m, d, _, b, p in rows}
        rows = [r for r in rows if last[(r[0], r[1], r[5], r[3], r[2])] == r[6]]
        for s, t, m, d, v, b, _ in rows:
            if (s, t) not in owners:
                owners[s, t] = d, min(x[2] for x in rows if (*x[:2], x[3], x[5]) == (s, t, d, b))
            owner, cutover = owners[s, t]
            if d == owner:
                what = "before_cutover" if m < cutover else "inserted" if (s, t, m) not in held else "duplicate" if held[s, t, m] == v else "updated"
                if what in ("inserted", "updated"):
                    held[s, t, m] = v
            else:
                what = "duplicate" if held.get((s, t, m)) == v else "conflict_duplicate" if (s, t, m, d) in quarantined else "conflict"
                if what == "conflict":
                    quarantined.add((s, t, m, d))
            out.append((s, t, m.replace(tzinfo=None), d, v, b, what))
    return sorted(out)


def test_stream_equals_a_plain_version(spark, tmp_path):
    rng, batches = random.Random(4), []
    for n in range(4):
        rows = [(rng.randrange(3), rng.choice("ab"), FROM + timedelta(minutes=rng.randrange(12)), rng.randrange(2), float(rng.randrange(2)), f"{n}-{p}", k) for p in range(3) for k in range(12)]
        batches.append([*rows, (None, "a", FROM, 0, 1.0, f"{n}-0", 99), (1, "a", None, 0, 1.0, f"{n}-0", 99), (1, "a", FROM, 0, None, f"{n}-0", 99)])
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    provider = spark.conf.get(authority.PROVIDER[0])
    for rows in batches:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(land)
        authority.run(spark.readStream.schema(FIELDS).parquet(land), out, str(tmp_path / "checkpoint"))
    assert spark.conf.get(authority.PROVIDER[0]) == provider
    got = [(r.subject_id, r.type, r.minute_ts, r.device_id, r.value, r.batch, r.outcome) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == plain(batches) and len({r[-1] for r in got}) == 6


class Counted:
    """A map of state that counts its accesses."""

    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def containsKey(self, key):  # noqa: N802
        self.calls.append(key)
        return key in self.held

    def getValue(self, key):  # noqa: N802
        self.calls.append(key)
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append(key)
        self.held[key] = value


class Handle:
    def __init__(self, calls):
        self.calls = calls

    def getMapState(self, *_):  # noqa: N802
        return Counted(self.calls)

    def getValueState(self, *_):  # noqa: N802
        return Owner()


class Owner:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held


def test_state_is_not_accessed_for_each_minute():
    calls, a = [], authority.Authority()
    a.init(Handle(calls))
    rows = [("0-0", 0, d, m * 60_000_000, float(m + d * (m % 2))) for d in (1, 2) for m in range(500)]
    names = ["batch", "place", "device_id", "minute", "value"]
    for want in ({"inserted": 500, "duplicate": 250, "conflict": 250}, {"duplicate": 750, "conflict_duplicate": 250}):
        out = [x for df in a.handleInputRows((1, "a"), iter([pd.DataFrame(rows[:300], columns=names), pd.DataFrame(rows[300:], columns=names)]), None) for x in df["outcome"]]
        assert {x: out.count(x) for x in set(out)} == want
    assert len(calls) <= 12
