"""Quality scores by compression: zstandard dictionaries from good and from bad labelled text."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold
from .toxicity import labelled

#: Most labelled rows that a fit takes, a parameter of ``fit``; pieces for each of them that teach a dictionary, another: those
#: of the least hashes among all pieces of the rows' whole texts. Rows of either label without which there is no fit.
MAX_FIT, PIECES, LEAST_ROWS = 6_000, 2, 20
#: Bytes of a dictionary, bytes of a piece that teaches one, and the level of compression.
DICTIONARY, PIECE, LEVEL = 64 * 1024, 2_048, 3
#: Fixed value: how trained dictionaries begin.
TRAINED = b"\x37\xa4\x30\xec"


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor of whole texts that starts from a dictionary, trained or plain text."""
    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(content, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


class Packed:
    """Two dictionaries, made into compressors once in each Python worker."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self._made = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "_made": None}

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of the text, and compressed with either dictionary."""
        if self._made is None:
            self._made = [_compressor(d) for d in (self.good, self.bad)]
        data = (text or "").encode("utf-8", "replace")
        return len(data), *(len(c.compress(data)) for c in self._made)

    def features(self, text: str | None) -> list[float]:
        """The normalised difference (positive: the good dictionary packs better), and the share that
        is left with the good one. Empty texts: zero and one."""
        n, g, b = self.sizes(text)
        return [(b - g) / max(g, b), g / n] if n else [0.0, 1.0]


def pieces(rows: DataFrame) -> DataFrame:
    """(label, piece) of rows (doc_id, text, label): whole texts as UTF-8, cut into pieces."""
    ship(rows.sparkSession)

    def cut(batches):
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                found = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["label", "piece"])

    return rows.select(F.col("label").cast("int"), "text").mapInArrow(cut, "label int, piece binary")


def _sample(rows: DataFrame, label: int, most: int) -> list[bytes]:
    """The pieces of one label with the least hashes, wherever in a text they stand."""
    mine = pieces(rows.where(F.col("label") == label))
    return [bytes(r["piece"]) for r in mine.orderBy(F.xxhash64("piece", F.lit(29)), "piece").limit(most).select("piece").toLocalIterator()]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = [s for s in samples if len(s) >= 16]
    if not samples:
        return b"\n" * 16
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: the text itself serves
        return b"\n".join(samples)[-size:]


class Model:
    def __init__(self, spark: SparkSession, packed: Packed | None, weights: list[float], bounds: list[tuple[float, float]]):
        self.packed, self.weights, self.bounds = spark.sparkContext.broadcast(packed), weights, bounds

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """docs with a score from 0 to 1; no shuffle."""
        ship(docs.sparkSession)
        packed, weights, bounds = self.packed, self.weights, self.bounds

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            if packed.value is None:
                return pd.Series([weights[0]] * len(texts), dtype="float64")
            x = design(np.array([packed.value.features(t) for t in texts], dtype=float).reshape(-1, 2), bounds)
            return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30))))

        return docs.withColumn(out, scored(F.col(text_col).cast("string")))


def design(f: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    """Scaled features, with a square of the share left: very low and very high are both bad."""
    z = np.stack([(f[:, i] - m) / s for i, (m, s) in enumerate(bounds)], axis=1)
    z = np.clip(z, -8, 8)
    return np.stack([np.ones(len(z)), z[:, 0], z[:, 1], z[:, 1] ** 2, z[:, 0] * z[:, 1]], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on a bounded calibration sample."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_FIT, id_col: str = "doc_id", text_col: str = "text", each: int = PIECES) -> Model:
    """Half of at most ``limit`` labelled rows makes the dictionaries, half calibrates the difference by
    logistic regression. A dictionary learns from ``each`` times ``limit`` pieces of 2,048 bytes of its label's texts at most; pieces
    under 16 bytes teach nothing. With fewer than 20 rows of either label the score is the labels' rate (0.5 for none)."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled(docs, labels, label, limit, id_col, text_col)
    train = rows.where("part in (0, 1)")
    counts = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in counts}
    if min(n.get(0, 0), n.get(1, 0)) < LEAST_ROWS or train.select("label").distinct().count() < 2:
        return Model(spark, None, [n.get(1, 0) / sum(n.values()) if n else 0.5], [])
    packed = Packed(*(_dictionary(_sample(train, v, each * limit), DICTIONARY) for v in (1, 0)))
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("array<double>")
    def feats(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.features)

    cal = rows.where("part in (2, 3)").select(feats("text").alias("f"), "label").toPandas()
    f = np.array(cal["f"].tolist(), dtype=float).reshape(-1, 2)
    bounds = [(float(f[:, i].mean()), float(f[:, i].std() or 1.0)) for i in range(2)]
    return Model(spark, packed, logistic(design(f, bounds), cal["label"].to_numpy(float)).tolist(), bounds)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; null and empty texts are scored like any
    other, an id that is null counts as not held out. No documents: no rows."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return model.score(narrow).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


__all__ = ["Packed", "fit", "quality_scores"]
