"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold, held

#: English and other insults that the labels need not teach, second-person words of
#: four languages, and signs that stand for letters.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile bastard".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros".split())
LOOKS = str.maketrans("0134578@$!|", "oieastbasil")
WORD = re.compile(r"[^\W_]+")
REPEATED = re.compile(r"(\w)\1\1")
#: What a plain lower-case word adds; tokens whose counts a worker remembers before it starts anew.
PLAIN, MEMO = (1, 0, 0, 0, 0, 0, 0, 0, 0), 300_000
#: Most labelled rows that a fit takes, chosen by a hash of the id; a parameter of ``fit``.
MAX_FIT = 20_000
#: Stems: word beginnings of these lengths; most terms of a lexicon; rows that a term must be in.
STEMS, MOST_TERMS, LEAST_ROWS = (4, 5), 2_000, 5
NEAR = 5
FEATURES = ("insults", "insult_share", "learned", "learned_share", "mild_share", "near_second_person", "capitals", "punctuation", "obfuscated", "repeated_letters", "exclaims", "length")


class Lexicon:
    """Built-in insults, with words and stems learned from labels. strong: at least 8 times as
    frequent in toxic rows; mild: at least 3 times."""

    def __init__(self, strong: set[str], mild: set[str]):
        self.insults, self.strong, self.mild = set(INSULTS), strong, mild
        self.memo: dict[str, tuple] = {}


def _terms(words: set[str]) -> set[str]:
    return words | {f"^{w[:n]}" for w in words for n in STEMS if len(w) > n}


def words_in(token: str) -> tuple[list[str], int]:
    """Lower-case words of a token between blanks, letters spelt out, and 1 if it was disguised."""
    core = token.strip(".,;:!?\"'()[]{}…-").lower()
    if core.isalpha():
        return [core], 0
    joined = "".join(WORD.findall(core.translate(LOOKS)))
    if joined.isalpha() and joined != core and any(map(str.isalpha, core)):
        return [joined], 1
    return WORD.findall(core), 0


def words_of(text: str) -> list[str]:
    return [w for t in text.split() for w in words_in(t)[0]]


def _of_token(token: str, lex: Lexicon) -> tuple:
    """Counts that one token adds: words, insults, learned, mild, disguised, capitals, signs,
    repeated letters, exclamation marks."""
    words, disguised = words_in(token)
    learned = sum(1 for w in words if w in lex.strong or any(f"^{w[:k]}" in lex.strong for k in STEMS if len(w) > k))
    return (
        len(words), sum(w in lex.insults for w in words), learned, sum(w in lex.mild for w in words), disguised, sum(map(str.isupper, token)),
        sum(not (c.isalnum() or c == "_") for c in token), len(REPEATED.findall(token)), token.count("!"),
    )


def features(text: str | None, lex: Lexicon) -> list[float]:
    """Dense features of one whole text; zeros where there are no words. Counts add up over distinct
    tokens, whose own counts a worker remembers, a bounded number of them."""
    tokens = (text or "").split()
    memo, total, hits = lex.memo, [0] * 9, set()
    for token, k in Counter(tokens).items():
        v = memo.get(token)
        if v is None:
            v = _of_token(token, lex)
            v = v if v != PLAIN else PLAIN
            if len(memo) >= MEMO:
                memo.clear()
            if len(token) <= 64:
                memo[token] = v
        if v is PLAIN:
            total[0] += k
            continue
        for i, x in enumerate(v):
            if x:
                total[i] += k * x
        if v[1] or v[2]:
            hits.add(token)
    n, insults, learned, mild, disguised, capitals, signs, repeated, exclaims = total
    if not n:
        return [0.0] * len(FEATURES)
    near = 0
    if hits:
        for i, t in enumerate(tokens):
            if t in hits and any(w.strip(".,;:!?").lower() in SECOND_PERSON for w in tokens[max(0, i - NEAR) : i + NEAR + 1]):
                near += 1
    marks = len(text) - len(tokens) + 1
    return [
        float(insults), 100.0 * insults / n, float(learned), 100.0 * learned / n, 100.0 * mild / n, 100.0 * near / n,
        100.0 * capitals / marks, 100.0 * signs / marks, 100.0 * disguised / n, 100.0 * repeated / n, 100.0 * exclaims / n, math.log1p(n),
    ]


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From labelled rows (text, label): terms in at least LEAST_ROWS toxic rows, by their ratio of
    frequencies. Spark counts the rows that hold each term; only the lists chosen, of at most MOST_TERMS
    terms each, come to the driver."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(_terms(set(words_of(t or "")))))

    n1, n0 = (max(1, x or 0) for x in rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    counts = rows.select("label", F.explode(terms("text")).alias("term")).groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    ratio = (F.col("toxic") / F.lit(float(n1))) / ((F.col("clean") + 0.5) / F.lit(float(n0)))
    ranked = held(counts.where(F.col("toxic") >= LEAST_ROWS).select("term", "toxic", ratio.alias("ratio")))
    order = [(F.col("toxic") * F.log(F.greatest("ratio", F.lit(1.0)))).desc(), F.col("term")]
    strong = ranked.where("ratio >= 8").orderBy(*order).limit(MOST_TERMS).select("term").collect()
    best = ranked.orderBy(*order).limit(MOST_TERMS).collect()
    return Lexicon({r["term"] for r in strong}, {r["term"] for r in best if 3 <= r["ratio"] < 8 and r["term"][0] != "^"})


class Model:
    """A fitted scorer: lexicon, trees and the calibration's steps."""

    def __init__(self, spark: SparkSession, lex: Lexicon, trees: GBTClassificationModel | None, steps: list[tuple[float, float]]):
        self.lex, self.trees, self.steps = spark.sparkContext.broadcast(lex), trees, steps

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """docs with a score from 0 to 1 beside its columns; a column of that name is replaced. Map
        side only: features in Python by Arrow batches, trees and calibration in the JVM."""
        ship(docs.sparkSession)
        lex = self.lex

        @F.pandas_udf("array<double>")
        def feats(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: features(t, lex.value))

        if self.trees is None:
            return docs.withColumn(out, F.lit(self.steps[0][1]))
        names = set(docs.columns)
        tmp = {k: next(n for n in (f"__{k}{i or ''}" for i in range(99)) if n not in names) for k in ("x", "raw", "p", "c")}
        trees = self.trees.copy().setFeaturesCol(tmp["x"]).setRawPredictionCol(tmp["raw"]).setProbabilityCol(tmp["p"]).setPredictionCol(tmp["c"])
        with_x = docs.withColumn(tmp["x"], array_to_vector(feats(F.col(text_col).cast("string"))))
        got = trees.transform(with_x).withColumn(out, calibrated(vector_to_array(tmp["p"])[1], self.steps))
        return got.drop(*tmp.values())


def calibrated(p: Column, steps: list[tuple[float, float]]) -> Column:
    """Piecewise linear between the steps of the isotonic fit, flat beyond the ends."""
    expr = F.lit(steps[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(steps[:-1], steps[1:], strict=True))):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        expr = F.when(p < x1, F.greatest(F.lit(y0), y0 + (p - x0) * slope)).otherwise(expr)
    return F.least(F.greatest(expr, F.lit(0.0)), F.lit(1.0))


def isotonic_steps(p: np.ndarray, y: np.ndarray, least: float = 1e-3) -> list[tuple[float, float]]:
    """Pool adjacent violators over a bounded calibration sample: (score, probability) at the middle
    of each pool, rates shrunk a little so that none is exactly 0 or 1. Of more than 40 pools the ones whose rates differ least
    from their neighbours' are left out, as each is a branch of the score's expression."""
    order = np.argsort(p, kind="stable")
    pools: list[list[float]] = []  # sum of y, weight, sum of p
    for q, v in zip(p[order], y[order], strict=True):
        if pools and pools[-1][2] / pools[-1][1] == q:
            pools[-1] = [pools[-1][0] + v, pools[-1][1] + 1, pools[-1][2] + q]
        else:
            pools.append([float(v), 1.0, float(q)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], s, strict=True)]
    pts = [(s / w, (v + least) / (w + 2 * least)) for v, w, s in pools]
    while len(pts) > 40:  # neighbours merge, the smallest steps first
        k = min(range(1, len(pts) - 1), key=lambda i: pts[i + 1][1] - pts[i - 1][1])
        pts.pop(k)
    return pts


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label, part): at most ``limit`` rows that are not held out, in an order by hash
    of the id. Ids with labels that differ count with the larger."""
    key = F.col(id_col).cast("long").alias("doc_id")
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    known = known.where(fold() != 1).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(limit)
    texts = docs.select(key, F.col(text_col).cast("string").alias("text"))
    return held(texts.join(F.broadcast(known), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_FIT, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Three quarters of the labelled rows teach lexicon and trees, one quarter the calibration.

    At most ``limit`` labelled rows are used, whole texts; the lexicon is counted and the trees are
    fitted by Spark. With fewer than 20 rows of either label the score is the labels' rate (0.5 for none)."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled(docs, labels, label, limit, id_col, text_col)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 20:
        n = sum(counts.values())
        return Model(spark, Lexicon(set(), set()), None, [(0.0, counts.get(1, 0) / n if n else 0.5)])
    lex = learn_lexicon(rows.where("part <> 0"))
    shared = spark.sparkContext.broadcast(lex)

    @F.pandas_udf("array<double>")
    def feats(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t, shared.value))

    data = held(rows.select("doc_id", F.col("label").cast("double").alias("label"), "part", array_to_vector(feats("text")).alias("features")))
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=5, seed=7).fit(data.where("part <> 0").coalesce(4))
    cal = trees.transform(data.where("part = 0")).select(vector_to_array("probability")[1].alias("p"), "label").toPandas()
    return Model(spark, lex, trees, isotonic_steps(cal["p"].to_numpy(), cal["label"].to_numpy()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; null and empty texts are scored like any
    other, an id that is null counts as not held out. No documents: no rows."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return model.score(narrow).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def toxic_removed(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those that score at least ``threshold``."""
    model = fit(docs, labels)
    name = next(n for n in (f"__score{i or ''}" for i in range(99)) if n not in docs.columns)
    return model.score(docs, out=name).where(F.col(name) < threshold).drop(name)
