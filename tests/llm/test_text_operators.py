"""Line dedup, token counts and SimHash against plain versions, and their edge cases."""

import hashlib
import random

import pytest
import xxhash

from pulseframe.llm import line_dedup, simhash, token_count
from pulseframe.llm.queries import tokenizer_path

BLANK = " \t\n\x0b\x0c\r"
UP = {chr(c): chr(c + 32) for c in range(65, 91)}


def key(line):
    return "".join(UP.get(c, c) for c in line.strip(BLANK))


def plain_lines(rows, min_docs=5, least=40):
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != d for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_equals_plain_version(spark):
    rng = random.Random(1)
    pool = [("Common line number %d " % i + "é" * 30) for i in range(6)] + ["short", "", "  PADDED Line " + "x" * 40 + "\t"]
    rows = [(d, "\n".join(rng.choice(pool + [f"own {d} {rng.random()} " * 3]) for _ in range(rng.randint(0, 6)))) for d in range(60)] + [(None, pool[0]), (7, pool[0]), (99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.digest(df).collect()), key=str) == plain_lines(rows)
    for batches in (1, 7):
        again = line_dedup.dedup_lines(df, batches=batches).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(cast(kept_text as binary), 256)")
        assert sorted(map(tuple, again.collect()), key=str) == plain_lines(rows)


def test_repeated_ids_count_as_one_document(spark):
    shared = "A line of more than forty signs that two documents hold."
    rows = [(1, f"{shared}\nrow {k}") for k in range(5)] + [(2, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.digest(df).collect()), key=str) == plain_lines(rows)
    more = rows + [(d, shared) for d in (3, 4, 5)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.digest(df).collect()), key=str) == plain_lines(more)


def test_line_runs_compact_and_find_new_lines(spark):
    runs = line_dedup.LineRuns(spark, fan=2)
    seen = []
    for k in range(4):
        batch = spark.createDataFrame([(10 * k + i, "shared line " + "s" * 40 + f"\nline of batch {k} " + "b" * 40) for i in range(2)], "doc_id long, text string")
        seen.append(line_dedup.stream_new_lines(runs, batch).count())
    assert seen == [2, 1, 1, 1]
    assert {k: len(v) for k, v in runs.levels.items() if v} == {2: 1}
    assert runs.read().agg({"n_docs": "max"}).first()[0] == 8
    runs.add(line_dedup.batch_run(line_dedup.long_lines(batch, "doc_id", "text", 40)))
    owners = runs.read().where("owner is not null").groupBy("h1", "h2").count()
    assert owners.count() == 5 and owners.agg({"count": "max"}).first()[0] == 1
    found = runs.fresh(batch.selectExpr("doc_id as h1", "doc_id as h2", "doc_id as n_docs", "doc_id as owner"))
    assert "LeftAnti" in found._jdf.queryExecution().executedPlan().toString()
    runs.close()


def test_dedup_keeps_extra_columns_and_empty_tables(spark, docs):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rng, parts = random.Random(2), ["a", "the", " the", " ", "  ", "\n", "\r\n", "'s", "12", "é", "日本", "<|endoftext|>", "\x1c", "\xa0", "!!", "👍🏽", "Ünïcode", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(500)]
    count = token_count.Counter(open(path, encoding="utf-8").read()).count
    assert [count(x) for x in texts] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, path).collect()}
    assert got[2] == (0, 0, False) and got[3] == (0, 0, False) and got[5][0] == 150_000 and got[5][2]
    assert token_count.token_counts(docs.limit(0), path).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in BLANK else UP.get(c, c) for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 2, 3, 60, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"W{rng.randrange(900)}"
            rows.append((len(rows), rng.choice([" ", "\t", " \n"]).join(w)))
    rows += [(len(rows), None)]
    fps = {d: plain_fingerprint(t) for d, t in rows}
    top = {d: d for d in fps}

    def find(u):
        return u if top[u] == u else find(top[u])

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk_rows in (simhash.simhash_groups(df),):
        got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in chunk_rows.collect()}
        assert got == {d: (fps[d], find(d)) for d in fps}
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, min(d for d in fps if fps[d] == f)) for f in set(fps.values())], "fp long, rep long")
    whole = {tuple(r) for r in simhash.components(simhash.links(reps)).collect()}
    assert {tuple(r) for r in simhash.components(simhash.links(reps, chunk=2)).collect()} == whole


def test_simhash_edge_cases(spark, docs):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert {(1, 1), (4, 1), (2, 2), (3, 2), (6, 2), (None, None)} <= got
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    assert simhash.near_copies_removed(docs).where("doc_id = 4").count() == 0
