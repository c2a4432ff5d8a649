"""Line dedup over levelled sorted runs of line hashes, in DataFrame and SQL functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

#: The bytes stripped from a line's ends, and the letters that are lower-cased.
BLANKS = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches of a whole table, and runs of a level before they are merged into one of the next level.
BATCHES, FAN = 6, 3
KEY, RUN = ["h1", "h2"], "h1 long, h2 long, n_docs long, owner long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """All lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(line: Column, least: int) -> Column:
    """128 bits of a line's key, or null for keys under ``least`` code points."""
    key = line_key(line)
    return F.when(F.char_length(key) >= least, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


class LineRuns:
    """Runs of (h1, h2, n_docs, owner) in levels, bucketed and sorted by hash.

    A batch is (h1, h2, n_docs, owner): one row for each line of some documents, with the number of
    those that hold it and the one that is to keep it. ``add`` merge-anti-joins a batch with the runs: the
    batch owns the lines that no run holds; of the others its run keeps the counts and no owner. So each
    line has one owner, from the first batch that held it. Once FAN runs of a level have come they are
    compacted into one of the next, so that a batch meets a number of runs that grows with the logarithm
    of the number of batches. Batches must not share documents. Runs are tables in the shared folder: a
    lost executor loses none, and joins read them by bucket, without a shuffle."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: dict[int, list[tuple[str, str]]] = {}

    def runs(self) -> list[tuple[str, str]]:
        """Table and folder of each run."""
        return [r for k in sorted(self.levels) for r in self.levels[k]]

    def read(self, runs: list[tuple[str, str]] | None = None) -> DataFrame:
        """The rows of runs, by their folders: a union of bucketed scans would claim a partitioning that
        it loses once a plan drops the buckets."""
        folders = [path for _, path in (self.runs() if runs is None else runs)]
        return self.spark.read.schema(RUN).parquet(*folders) if folders else self.spark.createDataFrame([], RUN)

    def _owned(self) -> list[DataFrame]:
        """The lines that each run owns, by bucket."""
        return [self.spark.table(name).where("owner is not null").select(*KEY).hint("merge") for name, _ in self.runs()]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's lines that no run owns."""
        return reduce(lambda left, owned: left.join(owned, KEY, "left_anti"), self._owned(), batch)

    def seen(self, batch: DataFrame) -> DataFrame:
        """The batch's other lines, without an owner. A line has one owner, so none comes twice."""
        parts = [batch.join(owned, KEY, "left_semi").withColumn("owner", F.lit(None).cast("long")) for owned in self._owned()]
        return reduce(DataFrame.unionByName, parts)

    def _write(self, run: DataFrame, level: int) -> None:
        name, path = f"spark_catalog.default.lines_{level}_{uuid.uuid4().hex}", scratch_path(self.spark, f"lines-{level}")
        out = run.write.format("parquet").option("path", path)
        out.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.levels.setdefault(level, []).append((name, path))

    def add(self, batch: DataFrame) -> None:
        self._write(self.fresh(batch).unionByName(self.seen(batch)) if self.runs() else batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            runs = self.levels.pop(level)
            self._write(merged(self.read(runs)), level + 1)
            self._drop(runs)
            level += 1

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Takes the runs off the catalog; their files go when the session ends."""
        self._drop(self.runs())
        self.levels = {}


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def long_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, mark, at, h1, h2): where each line with a key of at least ``least`` code points stands. mark
    tells rows of one id apart. Rows without an id hold none."""
    places = F.filter(F.transform(lines_of(F.col(text_col)), lambda x, i: F.struct(i.alias("at"), _hashed(x, least).alias("h"))), lambda p: p["h"].isNotNull())
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _mark(text_col).alias("mark"), F.explode(places).alias("p"))
    return held.select("id", "mark", "p.at", "p.h.h1", "p.h.h2")


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def batch_run(lines: DataFrame) -> DataFrame:
    """One batch from its lines (id, h1, h2): documents that hold each line, and the largest id of them.

    Pairs of line and document are made distinct first, dealt by both, and counts are partial before
    they are dealt by line, so a line that a third of all documents hold is no hot key."""
    return lines.select("id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("owner"))


def repeated_lines(lines: DataFrame, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, owner): the lines of at least ``min_docs`` documents, and the largest id holding each.

    lines: (id, h1, h2). Batches are ranges of ids with about as many lines each, the largest ids
    first, so that the first batch with a line is the one with its largest id."""
    at = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("id", at, 10_000)).first()[0] or []
    runs = LineRuns(lines.sparkSession)
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in reversed(list(zip(bounds[:-1], bounds[1:], strict=True))):
        part = lines if low is None else lines.where(F.col("id") > low)
        runs.add(batch_run(part if high is None else part.where(F.col("id") <= high)))
    found = written(merged(runs.read()).where(F.col("n_docs") >= min_docs).select(*KEY, "owner"), "repeated")
    runs.close()
    return found


def _mask(docs: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """(__id, __mark, __drops): for each text that loses lines whether its lines, up to the last lost,
    go."""

    def dropped_after(at: Column, i: Column) -> Column:
        """False for each line since the last dropped one, then true: one look-up for a line later,
        however many lines a text has."""
        before = F.when(i > 0, F.get(F.col("__gone"), i - 1)).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(False), at - before - 1), F.array(F.lit(True)))

    gone = lines.join(found, KEY).where(F.col("id") < F.col("owner")).groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
    gone = gone.agg(F.sort_array(F.collect_set("at")).alias("__gone"))
    return gone.select("__id", "__mark", F.flatten(F.transform("__gone", dropped_after)).alias("__drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, least: int = 40, batches: int = BATCHES) -> DataFrame:
    """docs with ``kept_text``, ``n_lines`` and ``n_dropped`` beside the columns there were.

    A line whose key (ends stripped, A-Z lower-cased) has at least ``least`` code points and is in at
    least ``min_docs`` documents stays only in the largest id that holds it, there with all its
    occurrences; other lines stay. A null or empty text is one empty line, and its kept text is
    empty. A row without an id keeps its lines and counts for none. Rows that share an id are one
    document to the counts; each keeps its own lines. Columns named like the new ones are replaced. No
    documents: no rows.

    The long lines' hashes are written once; batches of them go through levelled runs."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"kept_text", "n_lines", "n_dropped"}])
    places = written(long_lines(docs, id_col, text_col, least), "lines")
    gone = _mask(docs, places, repeated_lines(places, min_docs, batches))
    joined = docs.join(gone, (docs[id_col].cast("long") == gone["__id"]) & (_mark(text_col) == gone["__mark"]), "left").drop("__id", "__mark")
    # The mask is made below the join, once for a text and not inside the filter of its lines.
    lines = lines_of(F.col(text_col))
    stays = F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col("__drops"), i), F.lit(False)))
    kept = F.when(F.col("__drops").isNull(), lines).otherwise(stays)
    return (
        joined.withColumn("__kept", kept)
        .withColumn("kept_text", F.array_join("__kept", "\n"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.size(lines).cast("long") - F.size("__kept").cast("long"))
        .drop("__drops", "__kept")
    )


def stream_new_lines(runs: LineRuns, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40) -> DataFrame:
    """One micro-batch of documents: its lines (h1, h2, n_docs, owner) that no earlier batch held; then
    the batch joins the runs."""
    run = written(batch_run(long_lines(batch, id_col, text_col, least)), "batch")
    new = written(runs.fresh(run), "new")
    runs.add(run)
    return new


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = dedup_lines(docs.select(id_col, text_col), id_col, text_col)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["LineRuns", "batch_run", "dedup_lines", "digest", "line_key", "long_lines", "merged", "repeated_lines", "stream_new_lines"]
