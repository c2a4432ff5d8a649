"""WARC, embeddings, classifiers, decontamination, personal data and mixing."""

import gzip
import random
import re

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from pulseframe.llm import decontaminate, embedding_dedup, mixing, pii, quality, queries, toxicity, warc

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, DIR), queries.oracle_sql()[name], DIR)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "ä" * 600
    pages = spark.createDataFrame([(1, "http://a.example/x", big), (2, "http://a.example/y", big), (3, None, None), (4, "u", ""), (None, "http://b.example/", big), (5, "http://c.example/", "small"), (6, "http://c.example/", "small")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    heads = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse_archive(f.read_bytes())]
    assert len(heads) == 3 * 7 and all(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    rows = {(r.page_id, r.response.kind): r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert bytes(rows[(2, "response")].response.payload).decode() == big
    assert rows[(1, "revisit")].request.id and rows[(1, "revisit")].payload_length == len(big.encode())
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.digest(pages).collect()}
    assert got == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (None, "response", None), (5, "response", None), (6, "response", None)}
    assert warc.digest(pages.limit(0)).count() == 0


def test_warc_urls_are_read_back(spark, tmp_path):
    urls = {1: "http://www.example.org/index\\n", 2: "http://broken.example/a\r\n\r\nb"}
    pages = spark.createDataFrame([(i, u, "<p>x") for i, u in urls.items()], "page_id long, url string, html string")
    path = str(tmp_path / "u")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    want = {1: urls[1], 2: "http://broken.example/a b"}
    assert {r.uri for r in records.collect()} == set(want.values())
    assert {r.page_id: r.uri for r in warc.assemble(records).collect()} == want
    assert {r.payload_bytes for r in warc.digest(pages).collect()} == {4}


def test_warc_repeated_rows_and_references(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a.example/", big), (1, "http://a.example/", big), (2, "http://b.example/", big), (2, "http://b.example/z", big), (3, "u", "s"), (3, "u", "s"), (None, "u", big), (None, "u", big), (None, None, None)]
    pages = spark.createDataFrame([(*r, "extra", "e") for r in rows], "page_id long, url string, html string, payload string, digest string")
    got = sorted(map(tuple, warc.digest(pages).select("page_id", "record_type", "refers_to").collect()), key=str)
    want = [(1, "revisit", 2)] * 2 + [(2, "response", None)] * 2 + [(3, "response", None)] * 2 + [(None, "response", None)] * 3
    assert got == sorted(want, key=str)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path).collect()
    ids = {r.id: r for r in records}
    assert len(ids) == len(records) == 3 * len(rows)
    for r in records:
        assert r.concurrent is None or ids[r.concurrent].kind in ("response", "revisit")
        assert (r.refers is not None) == (r.kind == "revisit")
        assert r.refers is None or (ids[r.refers].kind == "response" and ids[r.refers].digest == r.digest)


def test_archives_are_unpacked_in_steps(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 7)
    head = b"HTTP/1.1 200 OK\r\nX-Long: " + b"h" * 9000 + b"\r\n\r\n"
    blocks = [head + b"body \r\n\r\n one", b"", b"WARC/1.1\r\n\r\n" * 3]
    record = lambda b: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b)
    whole = gzip.compress(b"".join(map(record, blocks)))
    single = b"".join(gzip.compress(record(b)) for b in blocks)
    for data in (whole, single, gzip.decompress(whole)):
        found = list(warc.parse_archive(data))
        assert [b for _, b in found] == blocks
        assert blocks[0][warc.body_at(*found[0]) :] == b"body \r\n\r\n one"
    assert [b for _, b in warc.parse_archive(gzip.decompress(whole)[:-9])] == blocks[:2]
    assert list(warc.parse_archive(b"")) == [] == list(warc.parse_archive(whole[:10]))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, vec = [], rng.normal(size=(30, 24))
    for i in range(260):
        x = vec[rng.integers(30)] + rng.normal(size=24) * rng.choice([0.0, 0.15, 0.25])
        rows.append((i, [float(v) for v in np.float32(x)], int(rng.integers(2))))
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, rows[0][1], None), (905, rows[0][1][:8], 0), (906, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, chunk=16).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[:260]}
    linked = {i: {j for j in unit if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93} for i in unit}
    exact = sum(got[i][0] == len(linked[i]) for i in unit)
    assert exact >= 0.95 * len(unit) and all(got[i][0] <= len(linked[i]) for i in unit)
    assert all(got[i] == (0, i, True) for i in range(900, 907))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_e8_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = embedding_dedup.e8_nearest(x)
    near = p[:, None, :] + embedding_dedup._shortest()[None]
    assert (((x - p) ** 2).sum(1) <= ((x[:, None] - near) ** 2).sum(2).min(1) + 1e-9).all()


def labelled_rows(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(900):
        bad, toxic = i % 3 == 0, i % 4 == 0
        w = [rng.choice(words) for _ in range(60)]
        if toxic:
            w[5:5] = ["you", "pathetic", "IDIOT!!", "m0ron"]
        text = " ".join(w)
        docs.append((i, (" ".join(f"{x.upper()}!!" for x in w) if bad else text), "en", "s", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(5000, None, None, None, None), (5001, "", "en", "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity.toxicity_scores, "toxic", 0.95), (quality.quality_scores, "quality", 0.95)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = labelled_rows(spark)
    out = score(docs, labels).join(labels, "doc_id", "left").toPandas()
    held = out[out["held_out"] & out[label].notna()]
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (held["predicted"] == held[label]).mean() >= least
    none = score(docs.limit(3), labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all()
    assert score(docs.limit(0), labels).count() == 0


def test_dictionaries_learn_from_whole_texts(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("абвгдежзик ") for _ in range(n))
    mark, rows = "the mark of a passage that stands behind the first pages", []
    for i in range(160):
        rows.append((i, noise(20_000) + mark * 40 if i % 2 else noise(3_000), i % 2, i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, label int")
    whole = {}
    for r in quality.pieces(df.orderBy("doc_id").coalesce(1)).collect():
        whole[r.label] = whole.get(r.label, b"") + bytes(r.piece)
    assert whole == {v: "".join(t for _, t, q, _ in rows if q == v).encode() for v in (0, 1)}
    packed = quality.fit(df, df).packed.value
    n, good, bad = packed.sizes(mark)
    assert good < n / 2 < bad


def test_isotonic_steps_rise():
    rng = np.random.default_rng(2)
    p = rng.random(500)
    steps = toxicity.isotonic_steps(p, (rng.random(500) < p).astype(float))
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(steps[:-1], steps[1:], strict=True))


def slow_align(item, window):
    best, h = 0.0, [[0.0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            s = decontaminate.MATCH if item[i - 1] == window[j - 1] else decontaminate.MISMATCH
            h[i][j] = max(0.0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best / len(item)


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, window = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        assert decontaminate.align(item, window)[0] == pytest.approx(slow_align(item, window))


def test_copies_of_benchmark_items_are_found(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(30)]
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    edited = list(item)
    for k in (3, 11, 20, 27):
        edited[k] = "changed"
    docs = [(1, " ".join(filler(50) + item + filler(50))), (2, " ".join(filler(20) + edited + filler(5)).upper()), (3, " ".join(filler(200))), (4, " ".join(filler(9) + item[:10] + filler(60))), (5, None), (6, ""), (7, "two words"), (None, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ", ".join(item)), (11, "Two  words"), (12, ""), (None, "x"), (13, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(df.union(df), bench.union(bench)).collect()]
    assert sorted(got, key=str) == sorted([(1, 10), (2, 10), (None, 10), (7, 11)] * 2, key=str)
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def test_no_alignment_is_missed():
    rng = random.Random(8)
    words = [f"t{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 15, 15, 30, 58)]
    block = decontaminate.Block(list(enumerate(items)))

    def edited(item, kind, every):
        out = []
        for i, w in enumerate(item, 1):
            hit = i % every == 0
            out += [] if hit and kind == "cut" else ["new"] if hit and kind == "change" else [w, "new"] if hit and kind == "insert" else [w]
        return out

    def plain(text):
        ids = np.array([block.vocabulary.get(w, 0) for w in text])
        return {(k, round(s, 6)) for k, item in enumerate(block.items) if (s := decontaminate.align(item, ids)[0]) >= decontaminate.LEAST}

    found = 0
    for kind in ("change", "insert", "cut"):
        for every in (2, 3, 4, 5):
            for k, item in enumerate(items):
                text = [rng.choice(words) for _ in range(40)] + edited(item, kind, every) + ["z"] * 100 + [rng.choice(words) for _ in range(40)]
                got = {(i, s) for i, s, *_ in block.matches(" ".join(text))}
                assert got == plain(text), (kind, every, k)
                found += k >= 5 and k in {i for i, _ in got}
    assert found >= 20


def test_seeds_miss_no_copy_that_brute_force_finds(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 15, 30, 58]))] for _ in range(60)]
    texts = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 2:
            copy, every = list(rng.choice(items)), rng.choice([3, 4, 5, 6, 100])
            copy = [x for k, w0 in enumerate(copy, 1) for x in ([w0] if k % every else rng.choice(([], ["new"], [w0, "new"])))]
            at = rng.randint(0, len(w))
            w[at:at] = copy
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, row string, score double")
    bench = spark.createDataFrame([(i, " ".join(x), "x", 1) for i, x in enumerate(items)], "item_id long, text string, key string, code int")
    block = decontaminate.Block(list(enumerate(items)))
    want = set()
    for d, t in enumerate(texts):
        ids = np.array([block.vocabulary.get(x, 0) for x in t.split()], dtype=np.int64)
        want |= {(d, k, round(s, 6)) for k, x in enumerate(block.items) if (s := decontaminate.align(x, ids)[0]) >= decontaminate.LEAST}
    got = [(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150
    monkeypatch.setattr(decontaminate, "MOST_KEYS", 0)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(300)) - {d for d, *_ in want}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - (9 if int(c) > 4 else 0)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_plain_patterns(spark):
    rng = random.Random(7)
    parts = ["a", "bob", "@", "ex.com", ".", "1", "255", "256", "001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+", " ", "-", "é", "😀", "\n", "1.2.3.4", "a@b.c", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(600)] + [None, "", "9" * 30_000, "1 " * 5_000, "a@" * 3_000, "write to jan.roe at example dot com", "call (456) 555-2186 today", "host 10[.]0[.]0[.]7 up"]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.listed("pii_base").alias("b"), pii.listed("pii_spans").alias("s")).collect()
    for r in out:
        base = plain_spans(texts[r.doc_id])
        assert r.b == ",".join(base)
        assert set(base) <= set(r.s.split(",") if r.s else [])
    last = {r.doc_id: r.s for r in out}
    assert [last[len(texts) - k] for k in (3, 2, 1)] == ["email:9:35", "phone:5:19", "ip:5:19"]
    many = "".join(f"x{i}@y.de, 1.2.3.{i % 256} or a{i} at b dot com and " for i in range(4000))
    (r,) = pii.personal_data(spark.createDataFrame([(1, many, "x")], "doc_id long, text string, pii_base string")).select(pii.listed("pii_base").alias("b"), F.size("pii_spans").alias("n")).collect()
    assert r.b == ",".join(plain_spans(many)) and 12_000 <= r.n <= 12_100
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clean = pii.redacted(spark.createDataFrame([(1, "mail a@b.de or +49 30 1234567 é"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["mail [EMAIL] or [PHONE] é", None]


#: Hand-made texts with what the wide candidates should and should not take.
WIDE_YES = [
    ("email", "you can reach anna.k at posteo dot de any day", "anna.k at posteo dot de"), ("email", "Mail: sam(at)mail.example.org please", "sam(at)mail.example.org"), ("email", "ping dev_ops [at] corp [dot] io now", "dev_ops [at] corp [dot] io"),
    ("ip", "the server 192[.]168[.]4[.]20 is down", "192[.]168[.]4[.]20"), ("ip", "host at 10 . 20 . 30 . 40 again", "10 . 20 . 30 . 40"), ("card", "pay with visa 4111.1111.1111.1111 today", "4111.1111.1111.1111"), ("card", "card 5555/5555/5555/4444, thanks", "5555/5555/5555/4444"),
    ("phone", "call (415) 555-0132 after six", "(415) 555-0132"), ("phone", "tel. 212-555-0187 or later", "212-555-0187"), ("phone", "phone: 303.555.0101 works", "303.555.0101"),
]
WIDE_NO = ["They met at noon. Then they left", "sold at 3.50 each", "see section 1. 2. 3. 4 of the text", "ratio 1234/5678/9012/3456 of parts", "version 2 . 10. 3. 7 came out", "the order 4111.1111.1111.1112 was late", "page 120/340.560 of the book", "look at him. she said"]


def test_added_spans_on_hand_made_texts(spark):
    texts = [t for _, t, _ in WIDE_YES] + WIDE_NO
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.listed("pii_spans").alias("s")).collect()
    got = {r.doc_id: set(r.s.split(",")) - {""} for r in out}
    want = {i: f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for i, (k, t, x) in enumerate(WIDE_YES)}
    found = sum(want[i] in got[i] for i in want)
    wrong = sum(len(s - {want.get(i)}) for i, s in got.items())
    assert found >= 9 and wrong <= 1, (found, wrong, got)


def test_overlapping_candidates_keep_the_surer(spark):
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(d).alias("d")) for k, s, e, d in ((0, 2, 9, "7"), (0, 70, 75, "5"))])
    mask = pii._mask(spans, lambda x: x["d"])
    at = lambda s, e: pii._highest(mask, F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")))
    (r,) = spark.range(1).select(at(0, 2), at(0, 3), at(9, 70), at(60, 71), at(8, 200), at(74, 76), at(75, 99)).collect()
    assert tuple(r) == ("0", "7", "0", "5", "7", "5", "0")


def test_mixing(spark, docs):
    out = mixing.mixed(docs, rate=1.0)
    assert out.count() == docs.count() and "score" in out.columns
    assert mixing.mixed(docs.limit(0)).count() == 0
    bare = mixing.mixed(docs.drop("source", "lang"), rate=1.0, topic_of=F.col("score"))
    assert bare.count() == docs.count() and {r.topic for r in bare.select("topic").collect()} == {"extra"}
    odd = spark.createDataFrame([("a", "en", "x", 5), ("b", "de", "x", 5)], "source string, lang string, topic string, n long")
    stuck = mixing.raked(odd, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 3, "de": 1}})
    assert stuck.count() == 2 and mixing.residual(stuck) > 0.1
    warned = spark.createDataFrame([(1, "w " * 5, "a", "en"), (2, "w " * 5, "b", "de")], "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="contradict"):
        off = mixing.mixed(warned, rate=1.0, targets={"source": {"a": 1, "b": 1}, "lang": {"en": 3, "de": 1}}).first().residual
    assert off > 0.1
    cells = spark.createDataFrame([(s, l, t, n) for s, l, t, n in (("a", "en", "x", 900), ("a", "de", "x", 50), ("b", "en", "x", 30), ("b", "de", "y", 20), ("c", "en", "y", 0))], "source string, lang string, topic string, n long")
    raked = mixing.raked(cells, targets={"source": {"a": 1, "b": 1}}, powers={"lang": 1.0, "topic": 1.0})
    assert mixing.residual(raked) <= 1e-9
    raked = raked.toPandas()
    assert raked.groupby("source")["w"].sum().to_dict() == pytest.approx({"a": 0.5, "b": 0.5}, abs=1e-9)
    probs = mixing.calibrated(spark.createDataFrame(raked), 0.5).toPandas().merge(raked)
    assert probs["prob"].max() <= 1 and (probs["prob"] * probs["n"]).sum() == pytest.approx(500)


def plain_raking(cells, targets, sweeps=20_000):
    """cells: (margin values…, n); targets: shares of each margin's values."""
    w = np.array([c[-1] for c in cells], float) / sum(c[-1] for c in cells)
    at = [np.unique([c[m] for c in cells], return_inverse=True) for m in range(3)]
    share = [np.array([t[v] for v in names]) for (names, _), t in zip(at, targets, strict=True)]
    for _ in range(sweeps):
        for (names, ids), t in zip(at, share, strict=True):
            w = w * (t / np.bincount(ids, w, len(names)))[ids]
    return w


def test_raking_reaches_feasible_targets(spark):
    rows = [("A", "x", "p", 100_000), ("B", "y", "p", 100_000), ("A", "y", "p", 10)]
    raked = mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, n long"), targets={"source": {"A": 6, "B": 4}, "lang": {"x": 1, "y": 1}})
    assert mixing.residual(raked) <= 1e-9
    assert {(r.source, r.lang): round(r.w, 8) for r in raked.collect()} == {("A", "x"): 0.5, ("A", "y"): 0.1, ("B", "y"): 0.4}


def test_raking_of_sparse_cells_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = sorted({(f"s{k}", rng.choice("abcd"), rng.choice("pqr")): rng.randrange(1, 10**6) for k in range(150) for _ in range(rng.choice((1, 2)))}.items())
    rows = [(*k, n) for k, n in rows]
    raked = mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, n long"))
    assert mixing.residual(raked) <= 1e-9
    total, targets = sum(r[3] for r in rows), []
    for m in range(3):
        sums = {v: (sum(r[3] for r in rows if r[m] == v) / total) ** 0.7 for v in {r[m] for r in rows}}
        targets.append({v: s / sum(sums.values()) for v, s in sums.items()})
    want = plain_raking(rows, targets)
    got = {(r.source, r.lang, r.topic): r.w for r in raked.collect()}
    assert [got[r[:3]] for r in rows] == pytest.approx(want.tolist(), rel=1e-6)
