"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MARGINS = ("source", "lang", "topic")
#: Powers of a margin's token shares that its target shares are proportional to (1: as they are, 0:
#: all alike), and the share of all tokens to keep.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}
RATE = 0.6
#: Sweeps go on until no margin's value is off its target by more than this share of it. Targets contradict each
#: other where a whole sweep moves no more than this weight and errors are left, or where so many rounds of two
#: sweeps take less than a tenth off the least error met.
TOLERANCE, STILL, PATIENCE = 1e-10, 1e-13, 60
#: Residual of which ``mixed`` warns.
RESIDUAL = 1e-6
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """The topic of documents that name none, by what kind of text they are: the first of these signs,
    else prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("icense")), "licensed").when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("[0-9]"), "numbers").otherwise("prose")
    )


def with_cell(docs: DataFrame, text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """docs with their cell as __source, __lang and __topic; null is a class of its own, written '', as is
    a column that there isn't. topic_of: the topic, where documents have one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = {c.lower() for c in docs.columns}
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in names else F.lit("")
    own = topic(text) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit(""))
    return docs.withColumns({"__source": plain("source"), "__lang": plain("lang"), "__topic": own})


def raked(cells: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, n) with w: shares that sum to 1 and have the target margins, as near as
    ``tolerance`` (``residual`` measures it). targets: explicit weights of some margins by value, others
    follow ``powers``; values that an explicit margin doesn't name get no weight.

    A sweep scales each margin in turn by its target over its sum: a partial aggregate joined back, so that
    a value with most of the cells is no group of one task. Each sweep is written in the shared folder, and two
    make a round. The next begins where the logarithms of the weights lead to at the pace of these two: sweeps end
    at the same weights from there, as only factors of margins have changed, but need far fewer rounds where cells are
    sparse. If a round so begun has a larger error, the next is a plain one."""
    powers = POWERS | (powers or {})
    some = cells.where("n > 0")
    total = some.agg(F.sum("n")).first()[0]
    out = some.withColumn("w", F.col("n") / F.lit(float(total or 1)))
    for m in MARGINS:
        given = (targets or {}).get(m)
        sums = some.groupBy(m).agg((F.sum("n") / F.lit(float(total or 1))).alias("s"))
        if given is None:
            share = F.pow("s", F.lit(float(powers[m])))
        else:
            named = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else None
            share = F.lit(0.0) if named is None else F.coalesce(F.element_at(named, F.col(m)).cast("double"), F.lit(0.0))
        sums = sums.select(m, share.alias("t"))
        whole = sums.agg(F.sum("t")).first()[0] or 1.0
        out = out.join(sums.select(m, (F.col("t") / F.lit(float(whole))).alias(f"t_{m}")), m)
    out, best, since, before, ahead = written(out, "raked"), float("inf"), 0, float("inf"), False
    while True:
        one = written(_sweep(out.withColumn("w0", F.col("w"))).drop("off"), "raked")
        out = written(_sweep(one.withColumn("w1", F.col("w"))), "raked")
        step, turn = F.ln("w1") - F.ln("w0"), F.ln("w") - 2 * F.ln("w1") + F.ln("w0")
        fine = (F.col("w") > 0) & (F.col("w0") > 0)
        sums = [F.sum(F.when(fine, step * step)), F.sum(F.when(fine, turn * turn)), F.sum(F.abs(F.col("w") - F.col("w1")))]
        error, r, v, moved = out.agg(F.max("off"), *sums).first()
        error = error or 0.0
        since, best = (0, error) if error < 0.9 * best else (since + 1, best)
        if error <= tolerance or moved is None or moved <= STILL or since >= PATIENCE:
            return out.drop("off", "w0", "w1")
        worse, before = ahead and error > before, error
        pace = (r / v) ** 0.5 if r and v else 1.0
        if ahead := pace > 1.0 and not worse:
            led = F.exp(F.ln("w0") + 2 * pace * step + pace * pace * turn)
            led = F.when(fine & ~F.isnan(led) & (led > 0) & (led < 1e6), led).otherwise(F.col("w"))
            # In a table of its own: the sweeps' code is the same each time, and compiled once.
            out = written(out.withColumn("w", led), "raked")
        out = out.drop("off", "w0", "w1")


def _sweep(cells: DataFrame) -> DataFrame:
    """cells with w scaled to each margin in turn, and ``off``: the largest error that it met."""
    cells = cells.withColumn("off", F.lit(0.0))
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("w").alias("s"))
        off = F.coalesce(F.abs(F.col("s") / F.nullif(F.col(f"t_{m}"), F.lit(0.0)) - 1), F.lit(0.0))
        scaled = F.coalesce(F.col("w") * F.col(f"t_{m}") / F.nullif("s", F.lit(0.0)), F.lit(0.0))
        cells = cells.join(sums, m).withColumns({"off": F.greatest("off", off), "w": scaled}).drop("s")
    return cells


def residual(cells: DataFrame) -> float:
    """The largest error of raked cells: how far a value of a margin is off its target, as a share of it."""
    off = F.abs(F.sum("w") / F.first(F.nullif("t", F.lit(0.0))) - 1).alias("off")
    margins = [cells.select(F.col(m), "w", F.col(f"t_{m}").alias("t")).groupBy(m).agg(off).select("off") for m in MARGINS]
    return reduce(DataFrame.unionAll, margins).agg(F.max("off")).first()[0] or 0.0


def calibrated(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """(source, lang, topic, prob): probabilities in proportion to w / n, at most 1, whose expected
    tokens are ``rate`` of all. Where cells reach 1 the others are scaled up; the scale is found in a
    few steps, each one sum over the cells."""
    total = cells.agg(F.sum("n"), F.sum(F.when(F.col("w") > 0, F.col("n")))).first()
    if not total[0]:
        return cells.select(*MARGINS, F.lit(1.0).alias("prob"))
    budget, scale = min(rate * total[0], float(total[1] or 0)), 0.0
    while True:
        full = F.lit(scale) * F.col("w") >= F.col("n")
        used, left = cells.agg(F.sum(F.when(full, F.col("n")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (budget - used) / left if left and left > 1e-15 else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return cells.select(*MARGINS, F.least(F.lit(1.0), scale * F.col("w") / F.col("n")).alias("prob"))


def chance(id_col: str) -> Column:
    """A number from 0 to 1 from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None) -> DataFrame:
    """The sampled rows of docs, with ``topic``, ``tokens``, ``prob`` and ``residual`` beside their columns: the largest share
    by which a margin's value stays off its target, of which a warning tells where targets contradict each other.

    Tokens are runs of other than white space. A row stays if the number that a hash of its id gives is
    under its cell's probability, so the same rows stay on any cluster. Rows of cells without tokens stay.
    Null source or language is a class of its own, as is a column that isn't there; topic_of names the
    topic, else ``topic`` does. Null and empty texts have no tokens; rows that share
    an id share its number; rows without an id share one number. Columns named like the new ones are
    replaced. No documents: no rows."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = with_cell(docs, text_col, topic_of).withColumn("__tokens", tokens)
    by = rows.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("n"))
    cells = written(by.select(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), "n"), "cells")
    weights = raked(cells, powers, targets)
    off = residual(weights)
    if off > RESIDUAL:
        warnings.warn(f"the target weights contradict each other: a margin stays off its target by {off:.3g} of it", stacklevel=2)
    probs = written(calibrated(weights, rate), "probs")
    probs = probs.select(*[F.col(m).alias(f"__p_{m}") for m in MARGINS], F.col("prob").alias("__prob"))
    on = [F.col(f"__{m}") == F.col(f"__p_{m}") for m in MARGINS]
    out = rows.join(probs, on, "left").withColumn("__prob", F.coalesce("__prob", F.lit(1.0)))
    out = out.where(chance(id_col) < F.col("__prob"))
    names = [c for c in docs.columns if c.lower() not in ("topic", "tokens", "prob", "residual")]
    own = [F.col(f"__{c}").alias(c) for c in ("topic", "tokens", "prob")]
    return out.select(*names, *own, F.lit(float(off)).alias("residual"))


def oracle_sql(docs: str = "documents", rate: float = RATE, sweeps: int = 30, powers: dict[str, float] | None = None) -> str:
    """The same in DuckDB SQL after so many sweeps as bring the fixture tables to the tolerance, with the scale found by ordering cells by how soon they reach 1."""
    powers = POWERS | (powers or {})
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'icense') THEN 'licensed'
       WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'numbers' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {docs})""",
        "c AS (SELECT source, lang, topic, sum(tokens) AS n FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
        "w0 AS (SELECT *, n / (SELECT sum(n) FROM c) AS w FROM c)",
    ]
    for m in MARGINS:
        ctes.append(f"t_{m} AS (SELECT {m}, pow(sum(w), {powers[m]}) / sum(pow(sum(w), {powers[m]})) OVER () AS t_{m} FROM w0 GROUP BY {m})")
    ctes.append("r0 AS (SELECT * FROM w0 " + " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS) + ")")
    at = 0
    for _ in range(sweeps):
        for m in MARGINS:
            ctes.append(f"r{at + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM r{at})")
            at += 1
    ctes += [
        f"o AS (SELECT *, w / n AS r, sum(n) OVER (ORDER BY w / n DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS full_n, sum(w) OVER (ORDER BY w / n DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r{at})",
        f"s AS (SELECT max(({rate} * (SELECT sum(n) FROM c) - coalesce(full_n, 0)) / rest) FILTER (WHERE ({rate} * (SELECT sum(n) FROM c) - coalesce(full_n, 0)) / rest * r < 1) AS scale FROM o)",
        f"p AS (SELECT source, lang, topic, least(1.0, scale * w / n) AS prob FROM r{at}, s)",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(coalesce(prob, 1.0), 6) AS prob
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic
WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(prob, 1.0)"""
