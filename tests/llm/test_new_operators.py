"""Collocations, conversation repair and sharding against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from pulseframe.llm import collocations, conversations, sharding


def plain_collocations(rows, least, widest, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, widest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, c in counts.items():
        cands = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        found = []
        for p, a in cands.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and inside(q) and 100 * f >= share * a for q, f in cands.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def texts(rng, n):
    words = ["the", "The", "new", "york", "times", "of", "é", "Ü", "x" * 30, "a"]
    ends = [" ", " ", " ", " ", ". ", ",", "\n", "\t", "  ", " ? "]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize(("shard_words", "widest", "share", "top"), [(40, 3, 50, 2000), (10**6, 3, 60, 7), (200, 4, 50, 2000), (1, 2, 50, 5)])
def test_collocations_equal_a_plain_version(spark, shard_words, widest, share, top):
    rows = texts(random.Random(shard_words), 120) + [("en", None), (None, ""), ("en", "..,\n"), ("fr", "new york " * 3000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = collocations.collocations(df, least=4, widest=widest, share=share, top=top, shard_words=shard_words)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, widest, share, top)


def test_collocations_of_nothing(spark, docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert {r.lang: r.n for r in collocations.collocations(docs).collect()} == {"de": 30_000}


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 4, 300), np.zeros(20, np.int64)])
    order = collocations.suffix_array(ids, 6)
    keys = [tuple(ids[i : i + 6]) for i in order]
    assert sorted(order) == list(range(len(ids)))
    assert [k for k in keys if len(k) == 6] == sorted(k for k in keys if len(k) == 6)
    some = order[ids[order] > 0]
    lcp = collocations.common_prefixes(ids, some, 4)
    for (a, b), n in zip(itertools.pairwise(some), lcp[1:], strict=True):
        same = itertools.takewhile(lambda xy: xy[0] == xy[1] and xy[0] > 0, zip(ids[a : a + 4], ids[b : b + 4], strict=True))
        assert n == len(list(same))


def test_a_large_count_is_exact(spark):
    df = spark.createDataFrame([("l", 1, "a", 4 * 10**12), ("l", 1, "b", 5 * 10**12), ("l", 2, "a b", 3 * 10**12), ("l", 0, "", 10**13)], "lang string, words int, phrase string, n long")
    assert [r.score for r in collocations.scored(df).collect()] == [10**6 * 9 * 10**24 // (20 * 10**24)]


PATTERN = re.compile(r"(s?(ua)+)?")


def plain_edits(rows):
    """All ways to edit a few rows, up to the price of deleting them all; the cheapest, ASCII-least one."""
    most, best = 2 * len(rows), None

    def go(i, cost, audit, out):
        nonlocal best
        if cost > most:
            return
        if i == len(rows) and PATTERN.fullmatch("".join(r[:1] for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda x: x[:2])
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*out, (role, "")])
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, cost + 2, audit + "D", out)
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            go(i + 1, cost + more, audit + "K", [*out, (role, text)])
            for new in ("user", "assistant"):
                go(i + 1, cost + 1 + more, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return best


def plain_repair(rows):
    out, by = [], defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    for conv, got in by.items():
        got.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faulty = set(), []
        for _, role, text in got:
            said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in got if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        n = Counter(f for *_, f in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, kept = plain_edits(faulty)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def conversation_rows(rng, convs):
    rows = []
    for c in convs:
        for _ in range(rng.randrange(1, 6)):
            turn = rng.choice([None, *range(9)])
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(["Hi.", "Yes!", "cut", " \t", "", None, "end. \n", "ü?"])))
    return rows


def test_repair_equals_a_plain_version(spark):
    rows = conversation_rows(random.Random(5), [*range(150), None, -3])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, audit string, fault int").repartition(7)
    got = sorted(map(tuple, conversations.digest(df).collect()), key=str)
    assert got == plain_repair(rows)
    assert conversations.digest(df.limit(0)).count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.digest(spark.createDataFrame([(conv, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in got.collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("block", [1, 2, 3, 50])
def test_blocks_change_nothing(block):
    rng = random.Random(block)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), str(k), rng.choice([0, 0, 1, 2])) for k in range(rng.randrange(7))]
        whole = conversations.Conversation(block)
        for r in rows:
            whole.add(*r)
        path = whole.end()
        cost, audit, kept = plain_edits([(r, t, ("", "blank", "truncated")[f]) for r, t, f in rows])
        assert (path.cost, path.audit()) == (cost, audit)
        assert path.hashed.hexdigest() == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def test_a_long_conversation_takes_linear_work():
    rng, conv = random.Random(1), conversations.Conversation()
    for k in range(30_000):
        conv.add(rng.choice(["user", "assistant"]), f"{k}.", rng.choice([0, 0, 0, 1, 2]))
    assert len(conv.end().audit().replace("I", "")) == 30_000


def test_repaired_rows_have_the_hash(spark):
    rows = [(c, k, r, t) for k, (c, r, t) in enumerate([(1, "system", "S."), (1, "assistant", "A."), (1, "user", "B."), (1, "user", ""), (1, "user", "C."), (2, "user", "Q?"), (2, "assistant", "no end"), (None, "tool", "x."), (None, "assistant", "y."), (3, "user", " "), (4, "", "e."), (4, "system", "S."), (4, "", "f."), (4, "tool", "u."), (4, "assistant", "a.")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {r.conv_id: r.repaired_sha256 for r in conversations.repaired(df).collect()}
    by = defaultdict(list)
    for r in conversations.repaired_rows(df).orderBy("conv_id", "position").collect():
        by[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(by[c]).encode()).hexdigest() for c in want} == want


def plain_shards(rows, shards):
    sized = sorted(((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), d) for d, t in rows))
    total, before, out, slots = sum(r[2] for r in sized), 0, [], Counter()
    for _, _, size, crc, d in sized:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((d, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_equal_a_plain_version(spark, docs, shards):
    rng = random.Random(shards)
    rows = [(rng.choice([None, *range(200)]), rng.choice(["", None, "ä" * rng.randrange(400), "copy"])) for _ in range(700)]
    df = spark.createDataFrame([(*r, "s", 9) for r in rows], "doc_id long, text string, law string, Slot int").repartition(6)
    out = sharding.sharded(df, shards=shards)
    got = sorted(map(tuple, out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()), key=str)
    assert got == plain_shards(rows, shards)
    assert out.columns == ["doc_id", "text", *sharding.NEW]
    assert sharding.digest(docs).count() == docs.count() and sharding.digest(docs.limit(0)).count() == 0


def test_shards_are_balanced_stretches(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(abs(hash(id)) % 300 AS int)) AS text")
    per = sharding.digest(df).groupBy("shard").agg({"size": "sum", "doc_id": "min", "slot": "max", "*": "count"}).orderBy("shard").toPandas()
    mean = per["sum(size)"].mean()
    assert len(per) == 40 and (per["sum(size)"] - mean).abs().max() <= 316
    assert per["min(doc_id)"].is_monotonic_increasing and (per["max(slot)"] + 1 == per["count(1)"]).all()


def test_written_shards(spark, docs, tmp_path):
    path = str(tmp_path / "s")
    sharding.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and set(back.columns) == set(docs.columns) | set(sharding.NEW)
    for f in (tmp_path / "s").rglob("*.parquet"):
        slots = pq.read_table(f, partitioning=None).column("slot").to_pylist()
        assert slots == sorted(slots)
