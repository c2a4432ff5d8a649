"""The pipeline against a plain run of its stages on a small fixture."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import key, plain_fingerprint

import corpus_pipeline as cp
from pulseframe.llm import simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [[rng.choice(words) for _ in range(25)] for _ in range(3)]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(80)]
        if i % 8 == 0:
            w[10:10] = ["you", "pathetic", "idiot", "moron", "scum"] * 2
        if i % 50 == 1:
            w[20:20] = items[i % 3]
        text = " ".join(w)
        if i % 10 == 3:
            text += "\nA line that many of the documents share, word for word.\nend"
        docs.append((i, text if i % 40 != 7 else docs[i - 1][1], rng.choice(["en", "de"]), rng.choice("abc"), len(text)))
        labels.append((i, 1, int("pathetic" in docs[-1][1])))
    docs += [(1000, None, None, None, None), (1001, "", "en", "a", 0)]
    d = str(tmp_path_factory.mktemp("p"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_stages_equal_plain_versions(spark, folder, tmp_path):
    d, docs, items = folder
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontaminate", "mixing"]
    now = spark.read.parquet(f"{d}/documents.parquet")
    states = []
    for name, stage in cp.STAGES:
        out = stage(spark, now, d)
        assert out.columns[:5] == list(cp.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        states.append({r.doc_id: r.text for r in now.collect()})
    text = {r[0]: r[1] for r in docs}
    assert set(states[0]) == {i for i in text if "pathetic" not in (text[i] or "")}
    line = "A line that many of the documents share, word for word."
    last = max(i for i in states[0] if line in (text[i] or ""))
    want = {i: t if i == last or not t else "\n".join(x for x in t.split("\n") if key(x) != key(line)) for i, t in states[0].items()}
    assert states[1] == {i: t or "" for i, t in want.items()}
    first = {}
    for i in sorted(states[1]):
        fp = plain_fingerprint(states[1][i])
        if not any((fp ^ other).bit_count() <= 3 for other in first.values()):
            first[i] = fp
    assert set(states[2]) == set(first)
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    assert set(states[3]) == {i for i, t in states[2].items() if not any(" ".join(x) in norm(t) for x in items)}
    assert 0 < len(states[4]) < len(states[3]) and set(states[4]) <= set(states[3])


def test_run_gives_the_last_stage(spark, folder):
    out = cp.run(spark, folder[0])
    assert {"topic", "tokens", "prob"} <= set(out.columns) and out.count() > 0


def test_near_copies_with_edits_go(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 400]))]
        rows.append((len(rows), w))
        for edits in (1, 2, 4, 8, 16):
            copy = list(w)
            for k in rng.sample(range(len(w)), min(edits, len(w) // 3)):
                copy[k] = "edited"
            rows.append((len(rows), copy))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    group = {i: i for i in sets}
    root = lambda i: i if group[i] == i else root(group[i])
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()}
    assert got == {i for i in sets if root(i) == i} and len(got) < len(sets) - 60


def shuffled(spark) -> int:
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_near_copies_shuffle_less_than_the_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))) for i in range(120)]
    rows += [(200, rows[7][1] + " more"), (201, rows[7][1]), (202, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled(spark)
    got = {(r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()}
    assert got == {(7, 7), (200, 7), (201, 7), (9, 9), (202, 9)}
    assert shuffled(spark) - before < sum(len(t) for _, t in rows) / 2


def test_shared_hashes_count_copies_of_a_set_once(spark):
    rng = random.Random(6)
    sets = {d * 7919 - 50: sorted(rng.sample(range(-40, 400), rng.randrange(6))) for d in range(90)}
    rows = [(d, ks) for d, ks in sets.items() for _ in range(1 + d % 3)]
    holders = {}
    for d, ks in sets.items():
        for k in ks:
            holders.setdefault(k, set()).add(d)
    got = simhash.shared_hashes(spark.createDataFrame(rows, "digest long, first array<long>").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted((d, k, min(ds)) for k, ds in holders.items() if len(ds) > 1 for d in ds)


def test_common_shingles_bring_no_sets_together(spark):
    rng = random.Random(7)
    common = [[f"c{i}x{j}" for j in range(5)] for i in range(30)]
    rows = [(i, " ".join(" ".join([*c, f"w{rng.randrange(10**9)}"]) for c in rng.sample(common, 30))) for i in range(2100)]
    rows.append((2100, rows[5][1] + " more"))
    before = shuffled(spark)
    got = {(r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk=16).collect()}
    assert got == {(5, 5), (2100, 5)}
    assert shuffled(spark) - before < 2.5 * sum(len(t) for _, t in rows)


def test_texts_stay_out_of_pairs_that_share_a_line_alone(spark):
    rng = random.Random(8)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    rows = [(i, " ".join([line, *(f"w{rng.randrange(10**6)}" for _ in range(3000 + 40 * i))])) for i in range(40)]
    rows.append((99, rows[3][1] + " more"))
    before, key = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    try:
        got = {(r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), distance=64).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {(3, 3), (99, 3)}
    assert shuffled(spark) - before < 2 * sum(len(t) for _, t in rows)


def test_near_copies_leave_no_tables_and_shuffles(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        found = set()
        while disk.hasNext():
            found.add(disk.next().getName())
        return {f for f in found if f.startswith("shuffle_")}

    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(60))) for i in range(50)]
    docs = spark.createDataFrame([*rows, (50, rows[4][1])], "doc_id long, text string")
    docs.collect()
    before = files()
    groups = simhash.similar_groups(docs)
    assert not files() - before
    assert {tuple(r) for r in groups.collect()} == {(4, 4), (50, 4)}


def similar_by_force(rows):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return {(i, g) for i, g in group.items() if list(group.values()).count(g) > 1}


@pytest.mark.parametrize("hot", [1, 3, 10**9])
def test_any_order_of_hashes_finds_the_same(spark, hot):
    rng = random.Random(10)
    common = [[f"c{i}x{j}" for j in range(8)] for i in range(12)]
    rows = []
    for i in range(60):
        w = [x for c in rng.sample(common, rng.randrange(1, 8)) for x in c]
        w += [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 40, 700]))]
        rows.append((len(rows), " ".join(w)))
        if i % 4 == 0:
            for k in rng.sample(range(len(w)), max(1, len(w) // 40)):
                w[k] = "edited"
            rows.append((len(rows), " ".join(w)))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), distance=64, chunk=2, hot=hot)
    assert {tuple(r) for r in got.collect()} == similar_by_force(rows)


def test_hot_hashes_stand_last_and_short_lists_are_read_again():
    sets = [[1, 2, 3, 4, 5], [1, 2, 3], [2, 3], [2, 7, 9], []]
    size, least = [9, 3, 2, 30, 0], [3, 2, 1, 3, 0]
    cols = [pa.array([10, 11, 12, 13, 14]), pa.array([20, 21, 22, 23, 24]), pa.array(size), pa.array(least), pa.array(sets, pa.list_(pa.int64()))]
    hot = SimpleNamespace(value=np.array([2, 3]))
    out = next(simhash._reordered([pa.RecordBatch.from_arrays(cols, names=["digest", "key", "n", "p", "first"])], hot)).to_pydict()
    assert out == {"digest": [10, 11, 12, 13, 14], "first": [[1, 4, 5], [1, 2], [2], [], []], "key": [None, None, None, 23, None]}


def test_parities_rule_no_similar_pair_out():
    rng = np.random.default_rng(3)
    rows, near = [], []
    for k in range(200):
        n = int(rng.integers(520, 9000))
        x, share = rng.integers(-(2**62), 2**62, n), rng.choice([0.1, 0.6, 0.89, 0.95])
        y = np.concatenate([x[: int(share * n)], rng.integers(-(2**62), 2**62, n - int(share * n))])[int(rng.integers(0, 3)) :]
        common = len(np.intersect1d(x, y))
        near.append(common / (len(x) + len(y) - common))
        rows.append((k, -k, n, len(y), *(simhash._odd(s, 1 << (len(s) - 1).bit_length()).tobytes() for s in (x, y))))
    rows.append((200, -200, 100, 90, b"", b""))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abnmxy"))
    kept = set(next(simhash._allowed([batch], 0.8)).column(0).to_pylist())
    assert {k for k, j in enumerate(near) if j >= 0.8} <= kept and 200 in kept
    assert not {k for k, j in enumerate(near) if j < 0.6} & kept and min(near) < 0.1 < 0.8 < max(near)
