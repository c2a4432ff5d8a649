"""Matching across channels against a plain version, and the queue's passes."""

import random

from pyspark.sql import functions as F

from pulseframe.operators import merge as M
from pulseframe.plans import merge_queries
from pulseframe.sources.canonical import Tables

DIR = "/root/testdata/sf0.001"


def plain(pairs):
    """One pass from the closest to the farthest pair."""
    state, tiers = {}, {}
    for a, b, dt in pairs:
        tiers.setdefault(dt, []).append((("in", a), ("ex", b)))
    for dt in sorted(tiers):
        open_ = [p for p in tiers[dt] if not any(e in state for e in p)]
        n = {}
        for p in open_:
            for e in p:
                n[e] = n.get(e, 0) + 1
        for p in open_:
            what = "matched" if all(n[e] == 1 for e in p) else "ambiguous"
            state.update(dict.fromkeys(p, what))
    return {e[1]: s for e, s in state.items() if e[0] == "in"}


def both(incoming, existing):
    pairs = [(r.in_id, r.ex_id, r.dt) for r in M.candidate_pairs(incoming, existing).collect()]
    got = M.match_across(incoming, existing).collect()
    assert len({r.in_id for r in got}) == len(got)
    assert {r.in_id: r.outcome for r in got} == plain(pairs)
    return pairs


def test_registered_input_matches_the_plain_version(spark):
    assert both(*merge_queries.matchable(Tables(spark, DIR)))


def test_a_constant_value_with_ties(spark):
    rng = random.Random(5)
    for step, ids in ((100, 45), (350, 45), (100, 30), (250, 60)):
        rows = [[(i, 1, "hr", 0, 7, 1_704_880_800_000 + step * rng.randint(0, 80)) for i in range(ids)] for _ in range(2)]
        frames = [spark.createDataFrame(r, "id long, subject_id long, type string, source_id int, value_key long, ms long").withColumn("start_ts", F.timestamp_millis("ms")) for r in rows]
        assert len(both(*frames)) > 50


def test_passes_take_ranges_in_order(spark):
    queue = spark.range(250).select("id", (F.col("id") % 2).alias("batch"))
    assert [r.id for r in M.pass_of(queue).orderBy("id").collect()] == list(range(100))
    assert [r.id for r in M.pass_of(queue, 3, batch=1).orderBy("id").collect()] == [1, 3, 5]
