"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, operator by operator."""

import random

import pytest

from pulseframe import store
from pulseframe.llm import decontaminate, embedding_dedup, mixing, pii, quality, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(1)
    words = [f"plain{i}" for i in range(50)]
    rows = []
    for i in range(100, 400):
        w = [rng.choice(words) for _ in range(30)] + (["you", "vile", "wretch"] * 3 if i % 2 else [])
        rows.append((i, " ".join(w), "en", "a", 1, "extra", 0.5))
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, tokens double")
    return more, spark.createDataFrame([(i, i % 2, i % 2) for i in range(100, 400)] + [(100, None, None), (None, 1, 1), (101, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers(spark, docs, labels, scores):
    more, known = labels
    both = docs.union(more)
    out = scores(both, known).toPandas()
    assert len(out) == both.count() and out["score"].between(0, 1).all() and set(out["predicted"]) <= {0, 1}
    four = out[out["doc_id"] == 4]
    assert len(four) == 2 and four["score"].nunique() == 1
    assert not out[out["doc_id"].isna()]["held_out"].any()
    assert scores(both.limit(0), known).count() == 0


def test_toxic_removed_keeps_columns(spark, docs, labels):
    more, known = labels
    kept = toxicity.toxic_removed(docs.union(more), known)
    assert kept.columns == docs.columns and kept.where("score = 'extra'").count() == kept.count()


def test_a_long_disguised_token_counts_as_one():
    lex = toxicity.Lexicon({"z" * 60}, set())
    assert toxicity.words_in("1d10t" + "x" * 60) == (["idiot" + "x" * 60], 1)
    assert toxicity.features("idiot " * 80, lex)[0] == 80


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "Hello World foo bar baz qux", "x"), (1, "x y z", "x"), (None, "long long", "x"), (2, None, "x")], "item_id long, text string, score string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1), (4, 1), (4, 1), (None, 1)], key=str)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5, 6]


def test_vectors_with_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1, 9), (1, [1.0, 0.0], 1, 9), (1, [0.0, 1.0], 2, 9), (2, [2.0, 0.0], 1, 9), (3, [1.0, 0.01], 1, 9), (None, [1.0, 0.0], 1, 9), (4, [1e300, 0.0], 1, 9), (5, [1.0, 0.0, 0.0], 1, 9)]
    for kind in ("double", "float"):
        df = spark.createDataFrame([r for r in rows if kind == "double" or r[0] != 4], f"vec_id long, embedding array<{kind}>, label int, n_links int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
        near = 3 if kind == "double" else 2
        assert got == {1: (near, 1), 2: (near, 1), 3: (near, 1), 5: (0, 5)} | ({4: (near, 1)} if kind == "double" else {})


def test_personal_data(spark, docs):
    out = pii.personal_data(docs.withColumnRenamed("score", "pii_spans"))
    assert out.count() == docs.count() and out.where("size(pii_spans) > 0").count() == 0
    assert pii.redacted(docs).select("text").collect() == docs.select("text").collect()


def test_ties_and_ids_in_mixing(spark, docs):
    out = mixing.mixed(docs, rate=0.5)
    assert set(docs.columns) - {"tokens"} <= set(out.columns) and out.where("doc_id = 4").count() in (0, 2)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
