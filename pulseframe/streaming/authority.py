"""Device authority as keyed state of a stream: each subject and type keeps its authoritative device, the cutover, the minutes
that count and the conflicts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

KEY = ["subject_id", "type"]
JUDGED = "subject_id long, type string, minute long, device_id long, value double, batch string, outcome string"
ROW = ["batch", "place", "device_id", "minute", "value"]
#: Microseconds of a week; one of a subject and type has 10,080 minutes at most.
WEEK = 7 * 86_400_000_000
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _packed(code: str, values) -> bytes:
    return array(code, values).tobytes()


def _unpacked(code: str, data: bytes) -> array:
    out = array(code)
    out.frombytes(data)
    return out


class Authority(StatefulProcessor):
    """Judges the minutes of one subject and type in the order of their payloads. State is kept by weeks of minutes, each
    read and written once at most in a micro-batch, as every access is a round trip between Python and the JVM."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "device_id long, cutover long")
        self.minutes = handle.getMapState("minutes", "week long", "minutes binary, vals binary")
        self.conflicts = handle.getMapState("conflicts", "week long", "minutes binary, devices binary, vals binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cols = [[v for some in parts for v in some] for parts in zip(*[[some[c].tolist() for c in ROW] for some in rows], strict=True)]
        some = sorted(zip(*cols, strict=True), key=lambda r: (r[0] is None, r[0], r[1] is None, r[1]))  # one micro-batch's minutes of one subject and type
        last = {(batch, device, minute): n for n, (batch, _, device, minute, _) in enumerate(some)}
        some = [some[n] for n in sorted(last.values())]
        owner = self.owner.get() if self.owner.exists() else None
        if owner is None:
            batch, _, device, _, _ = some[0]
            owner = (int(device), int(min(m for b, _, d, m, _ in some if (b, d) == (batch, device))))
            self.owner.update(owner)
        weeks: dict[int, list] = {}
        out = [self._judge(owner, weeks, int(minute), int(device), float(value)) for _, _, device, minute, value in some]
        for week, (held, seen, new, more) in weeks.items():
            if new:
                self.minutes.updateValue((week,), (_packed("q", held), _packed("d", held.values())))
            if more:
                self.conflicts.updateValue((week,), (_packed("q", (m for m, _ in seen)), _packed("q", (d for _, d in seen)), _packed("d", seen.values())))
        batch, _, device, minute, value = zip(*some, strict=True)
        yield pd.DataFrame({**dict(zip(KEY, key, strict=True)), "minute": minute, "device_id": device, "value": value, "batch": batch, "outcome": out})

    def _week(self, weeks: dict[int, list], week: int) -> list:
        """The minutes that count in a week, its conflicts if they were asked for, and whether either changed."""
        if week not in weeks:
            row = self.minutes.getValue((week,)) if self.minutes.containsKey((week,)) else None
            weeks[week] = [dict(zip(_unpacked("q", row[0]), _unpacked("d", row[1]), strict=True)) if row else {}, None, False, False]
        return weeks[week]

    def _judge(self, owner: tuple[int, int], weeks: dict[int, list], minute: int, device: int, value: float) -> str:
        of = self._week(weeks, minute // WEEK)
        held = of[0].get(minute)
        if device == owner[0]:
            if minute < owner[1]:
                return "before_cutover"
            if held == value:
                return "duplicate"
            of[0][minute], of[2] = value, True
            return "inserted" if held is None else "updated"
        if held == value:
            return "duplicate"
        if of[1] is None:
            at = (minute // WEEK,)
            row = self.conflicts.getValue(at) if self.conflicts.containsKey(at) else None
            of[1] = dict(zip(zip(_unpacked("q", row[0]), _unpacked("q", row[1]), strict=True), _unpacked("d", row[2]), strict=True)) if row else {}
        if (minute, device) in of[1]:
            return "conflict_duplicate"
        of[1][minute, device], of[3] = value, True
        return "conflict"

    def close(self) -> None:
        pass


def judged(minutes: DataFrame) -> DataFrame:
    """A stream of minutes (subject_id, type, minute_ts, device_id, value, batch, place) with their outcome, in the order of batch and
    place: a payload's last value of a minute counts.

    The first payload's device becomes the authority of its subject and type, from that payload's first minute on, and stays
    it. Its minutes are inserted, updated or duplicate, before_cutover where they lie earlier; those of other devices are
    duplicate, or once for each minute and device conflict. Late minutes are judged like others: there is no watermark. The
    state is kept by key in the checkpoint, so that no batch reads what was stored before."""
    ship(minutes.sparkSession)
    at = minutes.where("subject_id is not null and type is not null and minute_ts is not null and device_id is not null and value is not null")
    rows = at.select(*KEY, F.unix_micros("minute_ts").alias("minute"), "device_id", "value", "batch", "place")
    out = rows.groupBy(*KEY).transformWithStateInPandas(Authority(), JUDGED, "Append", "None")
    return out.withColumn("minute_ts", F.timestamp_micros("minute")).drop("minute")


def run(minutes: DataFrame, path: str, checkpoint: str):
    """Judges what has come, and appends it to a Parquet table; returns when done. The state store is RocksDB, which such state
    needs; the session's setting is as it was afterwards."""
    conf = minutes.sparkSession.conf
    name, provider = PROVIDER
    before = conf.get(name, None)
    conf.set(name, provider)
    try:
        stream = judged(minutes).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query = stream.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
