"""Embedding near-duplicates: E8 lattice hashing in several tables, with neighbouring cells probed."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import written
from .graph import components

#: Tables, lattice points in a key, cell size for projections that keep lengths on average, and
#: neighbouring cells probed for each table. At cosine 0.93 a pair is found with probability 0.99.
TABLES, BLOCKS, CELL, PROBES = 6, 2, 0.8, 4
#: Vectors of one bucket or class that one group of a task holds twice at most.
CHUNK = 256
SEED = 20_408


@lru_cache(maxsize=1)
def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: rounding, and where the sum is odd the coordinate
    that is least sure goes the other way."""
    f = np.rint(x)
    err = x - f
    worst, row = np.abs(err).argmax(axis=1), np.arange(len(x))
    odd = f.sum(axis=1).astype(np.int64) % 2 != 0
    f[row, worst] += np.where(odd, np.where(err[row, worst] >= 0, 1.0, -1.0), 0.0)
    return f


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even points and their shift by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=64)
def _projection(dim: int, t: int, b: int) -> np.ndarray:
    """dim x 8, orthonormal where dim allows, scaled so that lengths are kept on average."""
    rng = np.random.default_rng([SEED, dim, t, b])
    m = rng.normal(size=(max(dim, 8), 8))
    q, _ = np.linalg.qr(m)
    return q[:dim] * np.sqrt(max(dim, 8) / 8)


def lattice_cells(unit: np.ndarray, t: int, blocks: int = BLOCKS, cell: float = CELL, probes: int = PROBES) -> np.ndarray:
    """n x (1 + probes) keys of table t: the home cell, then the nearest neighbouring cells."""
    points, gains, short = [], [], _shortest()
    for b in range(blocks):
        y = unit @ _projection(unit.shape[1], t, b) / cell
        p = e8_nearest(y)
        points.append(p)
        gains.append((y - p) @ short.T)
    home = np.rint(2 * np.concatenate(points, axis=1)).astype(np.int64)
    best = np.argsort(-np.concatenate(gains, axis=1), axis=1, kind="stable")[:, :probes]
    odd = np.random.default_rng(SEED).integers(1, 2**63, size=8 * blocks, dtype=np.uint64) | np.uint64(1)
    # A neighbour differs by twice a shortest vector in one block, so its key by a table look-up.
    step = np.concatenate([(np.rint(2 * short).astype(np.int64).astype(np.uint64) * odd[8 * b : 8 * b + 8]).sum(axis=1, dtype=np.uint64) for b in range(blocks)])
    key = (home.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    return np.concatenate([key[:, None], key[:, None] + step[best]], axis=1).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cells(batches, tables: int, blocks: int, cell: float, probes: int):
    for batch in batches:
        if not len(batch):
            continue
        rid, lens, label = (np.asarray(batch.column(i)) for i in (0, 2, 3))
        out = []
        for n in np.unique(lens):
            at = np.flatnonzero(lens == n)
            x = _matrix(batch.column(1).take(pa.array(at)))
            # Largest component first, so that no square overflows or vanishes.
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for t in range(tables):
                k = lattice_cells(unit, t, blocks, cell, probes)
                w = k.shape[1]
                home = np.tile(np.arange(w) == 0, len(at))
                out.append(np.stack([np.repeat(rid[at], w), np.repeat(label[at], w), np.full(k.size, n), np.full(k.size, t), k.ravel(), home], axis=1).astype(np.int64))
        rows = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(6)], names=["rid", "label", "dim", "t", "cell", "home"])


def _cosines(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, as pyarrow batches; groups may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _vectors(group: pa.Table) -> np.ndarray:
    return _matrix(group.column("vec").combine_chunks() if group.column("vec").num_chunks > 1 else group.column("vec").chunk(0))


def _bucket_links(batches, least: float):
    for group in _groups(batches, 5):
        if len(group) < 2:
            continue
        rid = group.column("rid").to_numpy()
        near = _cosines(_vectors(group)) >= least
        np.fill_diagonal(near, True)
        label, top = rid.copy(), np.iinfo(np.int64).max
        while True:
            new = np.where(near, label[None, :], top).min(axis=1)
            if (new == label).all():
                break
            label = new
        moved = label != rid
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(rid[moved]), pa.array(label[moved])], names=["a", "b"])


def _class_counts(batches, least: float):
    for group in _groups(batches, 3):
        rid, n, mine = (group.column(c).to_numpy() for c in ("rid", "n", "mine"))
        near = _cosines(_vectors(group)) >= least
        np.fill_diagonal(near, False)
        if group.column("i")[0] != group.column("j")[0]:
            near &= mine[:, None] != mine[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(near @ n)], names=["rid", "links"])


def _met(rows: DataFrame, keys: list[str], cols: list[str], chunk: int) -> DataFrame:
    """Rows with a count m of their group, dealt to pairs of chunks (i, j) of it."""
    return (
        rows.withColumn("g", F.ceil(F.col("m") / chunk))
        .withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("g")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .select(*keys, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *cols)
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", least: float = 0.93, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per id.

    Vectors link when their labels are equal and not null and their cosine is at least ``least``.
    Vectors that are null, empty or zero, or hold null or non-finite components, have no links and are
    their own component; so do vectors of another length, and of rows without a label. Equal vectors
    are one class that is compared once and counts with its size. Rows that share an id are one vector:
    the one with the smallest label and components. Rows without an id are left out. No rows: none.

    Buckets give links enough to connect what lattice cells find; then the links within each class of
    connected vectors are counted exactly, chunk against chunk, so no pair leaves a task."""
    spark = vectors.sparkSession
    ship(spark)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    # Single precision is dealt as it is and compared in double precision.
    kind = "array<float>" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast(kind).alias("vec")).where("vec_id is not null")
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.*")
    fit = F.expr("label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(double(x)) < double('inf')) and exists(vec, x -> x <> 0)")
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    narrow = rows.select("vec_id", "fit", "label", F.size("vec").alias("dim"), "h1", "h2")
    same = ["label", "dim", "h1", "h2"]
    classes = written(narrow.where("fit").groupBy(*same).agg(F.min("vec_id").alias("rid"), F.count("*").alias("n")), "classes")
    reps = written(
        rows.where("fit").join(classes.select("rid", "n"), F.col("vec_id") == F.col("rid")).select("rid", "n", F.xxhash64("label").alias("label"), F.size("vec").alias("dim"), "vec"), "reps"
    )
    cells = reps.select("rid", "vec", F.col("dim").cast("long"), "label").mapInArrow(
        lambda b: _cells(b, TABLES, BLOCKS, CELL, PROBES), "rid long, label long, dim long, t long, cell long, home long"
    )
    cells = written(cells, "cells")
    bucket = ["label", "dim", "t", "cell"]
    shared = cells.groupBy(*bucket).agg(F.count("*").alias("m"), F.max("home").alias("any_home")).where("m > 1 and any_home = 1")
    shared = shared.withColumn("b", F.xxhash64(*bucket)).drop("any_home")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = cells.join(shared, bucket).join(reps.select("rid", "vec"), "rid")
    keys = ["label", "dim", "b", "i", "j"]
    pairs = _met(met, ["label", "dim", "b"], ["rid", "vec"], chunk).repartition(parts, *keys).sortWithinPartitions(*keys)
    linked = components(pairs.mapInArrow(lambda b: _bucket_links(b, least), "a long, b long"))
    members = linked.select(F.col("node").alias("rid"), "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    inner = members.join(sizes, "component").join(reps.select("rid", "n", "vec"), "rid")
    keys = ["component", "i", "j"]
    dealt = _met(inner, ["component"], ["rid", "n", "mine", "vec"], chunk).repartition(parts, *keys).sortWithinPartitions(*keys)
    counted = dealt.mapInArrow(lambda b: _class_counts(b, least), "rid long, links long").groupBy("rid").agg(F.sum("links").alias("links"))
    info = classes.join(members, "rid", "left").join(counted, "rid", "left").select(
        *same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component_id")
    )
    out = narrow.where("fit").join(info, same).select("vec_id", "n_links", "component_id")
    alone = narrow.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
