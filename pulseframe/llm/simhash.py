"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonhole blocks."""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ..store import drop_table, tidied
from .common import written
from .graph import components

#: Six blocks of 11 or 10 bits: two fingerprints at most 3 bits apart agree in at least 3 of them.
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Members of one bucket that one group of a task holds twice at most.
CHUNK = 128
#: A hash that more sets of unlike classes share goes last in the order in which they are looked through again.
HOT = 4 * CHUNK
#: Orders that are tried at most; the number changes no result.
ORDERS = 4
SEED = 42
#: Sets with fewer shingles are told apart by their parities alone: the estimate of SimHashes' distances is
#: for many.
SURE = 64
#: Columns of 64 parities each.
ODD = tuple(f"odd{k}" for k in range(8))
SKETCH = ("digest", "fp", "n", *ODD)
#: Columns of the hashes before a bucket's in a set's own order, 0 for none.
BEFORE = ("p1", "p2", "p3", "p4")
#: Bits of the filter of texts that are read again, as a power of two: 4 MB whatever the input. The fuller it is
#: the more texts are shuffled; none that is wanted is left out.
FILTER = 25


def _masks(distance: int) -> list[int]:
    """Masks of each choice of blocks that close pairs can share, as signed 64-bit integers."""
    blocks, at = [], 0
    for w in WIDTHS:
        blocks.append(((1 << w) - 1) << at)
        at += w
    keep = len(WIDTHS) - distance
    if keep < 1:
        raise ValueError("distance must be less than the number of blocks")
    whole = (sum(c) for c in combinations(blocks, keep))
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of one whole text; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        view, digest = memoryview(line), xxhash.xxh64_intdigest
        starts = [0, *ends[:-width]]
        hashes = [digest(view[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 50_000):
        part = np.array(hashes[k : k + 50_000], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp a signed long. Runs without a shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _close(batches, distance: int):
    """Links of each group of sorted rows (c, k, i, j, fp, rep): every member to the smallest
    representative that it reaches within the group. Groups hold at most about two chunks."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray):
        fp, rep = rows[:, 4].view(np.uint64), rows[:, 5]
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
        label = rep.copy()
        top = np.iinfo(np.int64).max
        while True:
            new = np.where(near, label[None, :], top).min(axis=1)
            if (new == label).all():
                break
            label = new
        moved = label != rep
        return rep[moved], label[moved]

    def out(pairs):
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1).astype(np.int64)
        if held:
            rows = np.concatenate([*held, rows])
            held = []
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        groups = np.split(rows, cuts)
        held = [groups[-1]]
        yield out([links(g) for g in groups[:-1] if len(g) > 1])
    if held and len(held[0]) > 1:
        yield out([links(held[0])])


def links(reps: DataFrame, distance: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between representatives of different fingerprints at most ``distance`` bits
    apart, enough to connect all that any chain of close pairs connects.

    reps: (fp, rep), one row per fingerprint. Every fingerprint goes to the 20 choices of 3 blocks;
    buckets with one member end there. A bucket of m members is cut into g chunks of about ``chunk``,
    and each pair of chunks is a group of its own, so no task holds a whole hot bucket, and only
    links to the smallest member reached leave a group, never all pairs."""
    spark = reps.sparkSession
    at = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(_masks(distance))]))
    blocks = reps.select("fp", "rep", at.alias("at")).select("at.c", "at.k", "fp", "rep")
    shared = blocks.groupBy("c", "k").agg(F.count("*").alias("m")).where("m > 1")
    mine = F.pmod(F.xxhash64("fp"), F.col("g"))
    met = (
        blocks.join(shared, ["c", "k"])
        .withColumn("g", F.ceil(F.col("m") / chunk))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .select("c", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "rep")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        met.repartition(parts, "c", "k", "i", "j")
        .sortWithinPartitions("c", "k", "i", "j")
        .mapInArrow(lambda batches: _close(batches, distance), "a long, b long")
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs.

    Null and empty texts have fingerprint zero and link like any other. Rows of one id share its
    group. A row without an id gets its fingerprint and no component, and links nothing. No
    documents: no rows. Equal fingerprints count once: only their smallest id goes on to the blocks.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "simhash")
    reps = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    # An id with several rows ties their fingerprints together.
    by_id = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).where("f0 <> f1")
    same = (
        fps.join(by_id.select("doc_id"), "doc_id", "left_semi")
        .join(reps, "fp")
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    found = components(links(reps, distance).unionByName(same))
    classes = reps.join(found, reps["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def hex64(c: str):
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words are one run, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    view, digest, width = memoryview(line), xxhash.xxh64_intdigest, min(width, len(words))
    starts = [0, *ends[:-width]]
    hashes = (digest(view[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)).view(np.int64))


def _least(n: int, least: float) -> int:
    """Of n shingles in a fixed order, so many of the first that two sets of similarity ``least`` always
    share one of them."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def _digest(items: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest(items.tobytes(), SEED)).view(np.int64)


def _odd(items: np.ndarray, size: int) -> np.ndarray:
    """``size`` parities of hashes by their last bits; size is a power of two."""
    return np.packbits((np.bincount(items & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """(doc_id, mark, digest, fp, n, odd…, p, wide, first) of rows with an id: hash of the text, hash of the set of
    its shingles, the set's SimHash, its size, the parities of its hashes by their last 9 bits, how many of its least
    hashes similar sets must share one of, and these with some more. wide: of larger sets a parity for each
    hash or more, by their last bits."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows, wide, first = [], [], []
            for t in batch.column(2):
                items = shingles(t.as_py(), width)
                n, p = len(items), _least(len(items), least)
                ones = np.zeros(64, dtype=np.int64)
                for k in range(0, n, 50_000):
                    ones += np.unpackbits(items[k : k + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fp = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0]
                wide.append(_odd(items, 1 << (n - 1).bit_length()).tobytes() if n > 64 * len(ODD) else b"")
                first.append(items[: p + p // 8 + 8])
                rows.append((_digest(items), fp, n, *_odd(items, 64 * len(ODD)).view(np.int64), p))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4 + len(ODD))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, pa.array(wide, pa.binary()), _lists(first)], names=["doc_id", "mark", *SKETCH, "p", "wide", "first"])

    return _marked(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "mark", *SKETCH, "p")) + ", wide binary, first array<long>")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _packed(batches, parts: int):
    """(part, digests, counts, hashes) from rows (digest, first): of each batch the different sets with hashes in
    a part of the hashes, how many each has there, and these."""
    for batch in batches:
        digest, at = np.unique(np.asarray(batch.column(0)), return_index=True)
        if not len(digest):
            continue
        first = batch.column(1).take(pa.array(at))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(first).to_numpy(zero_copy_only=False))])
        items = first.flatten().to_numpy().view(np.uint64)
        own = np.repeat(np.arange(len(digest)), np.diff(ends))
        part = (items % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, own, items = part[order], own[order], items[order].view(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, np.int64)
        rows = []
        for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
            sets, counts = np.unique(own[lo:hi], return_counts=True)
            rows.append((int(part[lo]), digest[sets].tobytes(), counts.astype("<i4").tobytes(), items[lo:hi].tobytes()))
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "digests", "counts", "hashes"])


def _shared(batches):
    """(digest, k, lo) from sorted rows of ``_packed``: the sets that hold a hash that two different ones or more
    hold, and the least of these. Copies of a set count once."""
    now, held = None, []

    def found():
        k, digest = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.lexsort((digest, k))
        k, digest = k[order], digest[order]
        one = np.concatenate([[True], (k[1:] != k[:-1]) | (digest[1:] != digest[:-1])])
        k, digest = k[one], digest[one]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.append(starts, len(k)))
        lo, many = np.repeat(digest[starts], n), np.repeat(n > 1, n)
        whole = pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (digest, k, lo)], names=["digest", "k", "lo"])
        for at in range(0, len(whole), 65_536):
            yield whole.slice(at, 65_536)

    for batch in batches:
        for part, *packed in zip(*batch.columns, strict=True):
            if held and part.as_py() != now:
                yield from found()
                held = []
            now = part.as_py()
            digests, counts, hashes = (np.frombuffer(c.as_py(), t) for c, t in zip(packed, ("<i8", "<i4", "<i8"), strict=True))
            held.append((hashes, np.repeat(digests, counts)))
    if held:
        yield from found()


def shared_hashes(rows: DataFrame) -> DataFrame:
    """(digest, k, lo): of the hashes ``first`` of each set those that another set has too, and the least set of
    those with it. rows: (digest, first). Sets and hashes go to the parts of the hashes once, packed by batches."""
    parts = 2 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("digest", "first").mapInArrow(lambda b: _packed(b, parts), "part long, digests binary, counts binary, hashes binary")
    return dealt.repartition(parts // 2, "part").sortWithinPartitions("part").mapInArrow(_shared, "digest long, k long, lo long")


def _rare_first(items: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The hashes with those of the sorted array ``hot`` last, and how many are not of these."""
    often = hot[np.minimum(np.searchsorted(hot, items), len(hot) - 1)] == items
    return np.concatenate([items[~often], items[often]]), len(items) - int(often.sum())


def _reordered(batches, hot):
    """(digest, first, key) from rows (digest, key, n, p, first): the first p hashes of the set when the hot ones
    stand last. A list that has too few others is left empty, and its key told: that text is to be read again."""
    for batch in batches:
        digest, key, n, p, first = batch.columns
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(first).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, lists, again = first.flatten().to_numpy(), [], []
        for k, (size, least) in enumerate(zip(n.to_pylist(), p.to_pylist(), strict=True)):
            items, rare = _rare_first(flat[ends[k] : ends[k + 1]], hot.value)
            again.append(rare < least and len(items) < size)
            lists.append(items[: 0 if again[-1] else least])
        yield pa.RecordBatch.from_arrays([digest, _lists(lists), pc.if_else(pa.array(again, pa.bool_()), key, pa.scalar(None, pa.int64()))], names=["digest", "first", "key"])


def _read_again(batches, bits, hot, width: int, least: float):
    """(digest, first), as of ``_reordered``, from the texts (text, key) whose keys are in the filter."""
    for batch in _filtered(batches, bits):
        sets = [shingles(t.as_py(), width) for t in batch.column(0)]
        lists = [_rare_first(x, hot.value)[0][: _least(len(x), least)] for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.int64()), _lists(lists)], names=["digest", "first"])


def _rarely_shared(rows: DataFrame, texts: DataFrame, hot: np.ndarray, width: int, least: float) -> DataFrame:
    """``shared_hashes`` of the sets when the hashes ``hot`` stand last in the order of all: similar sets share one
    of their first p in any order."""
    sc, key = rows.sparkSession.sparkContext, F.xxhash64("doc_id", "mark").alias("key")
    hot = sc.broadcast(np.sort(hot))
    lists = rows.select("digest", key, "n", "p", "first").mapInArrow(lambda b: _reordered(b, hot), "digest long, first array<long>, key long")
    bits = sc.broadcast(_wanted(lists.where("key is not null").select("key")))
    lists = lists.where("key is null").select("digest", "first")
    if bits.value.any():
        lists = lists.union(texts.select("text", key).mapInArrow(lambda b: _read_again(b, bits, hot, width, least), "digest long, first array<long>"))
    out = written(shared_hashes(lists), "shingles-rare")
    bits.unpersist()
    hot.unpersist()
    return out


def _met(batches, distance: int, least: float):
    """Pairs (a, b) of digests, a > b, from groups of sorted rows (k, i, j, class, digest, fp, n, odd…, p…):
    those of unlike classes that may be similar. A pair that shares one of the hashes before k met in that
    bucket already, so it is left to it; at the first hash that two sets share they share none before."""
    held: list[np.ndarray] = []

    def pairs(rows: np.ndarray):
        mine, digest, fp, n, odd = rows[:, 3], rows[:, 4], rows[:, 5].view(np.uint64), rows[:, 6], rows[:, 7:-len(BEFORE)].view(np.uint64)
        near = (mine[:, None] != mine[None, :]) & (digest[:, None] > digest[None, :])
        near &= np.minimum(n[:, None], n[None, :]) >= least * np.maximum(n[:, None], n[None, :]) - 1e-9
        unlike = sum(np.bitwise_count(odd[:, None, k] ^ odd[None, :, k]).astype(np.int16) for k in range(odd.shape[1]))
        near &= unlike <= (1 - least) / (1 + least) * (n[:, None] + n[None, :]) + 1e-9
        near &= (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance) | (np.minimum(n[:, None], n[None, :]) < SURE)
        x, y = np.nonzero(near)
        if len(x):
            a, b = rows[x, -len(BEFORE) :], rows[y, -len(BEFORE) :]
            first = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != 0)).any(axis=(1, 2))
            x, y = x[first], y[first]
        return digest[x], digest[y]

    def out(found):
        cols = [np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1).astype(np.int64)
        rows = np.concatenate([*held, rows])
        held = []
        if not len(rows):
            continue
        groups = np.split(rows, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1)
        held = [groups[-1]]
        yield out([pairs(g) for g in groups[:-1] if len(g) > 1])
    if held and len(held[0]) > 1:
        yield out([pairs(held[0])])


def _wanted(keys: DataFrame) -> np.ndarray:
    """One bit for each key by its first bits; what comes to the driver is bounded by the filter's own size."""
    at = F.shiftrightunsigned("key", 64 - FILTER)
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _filtered(batches, bits):
    """The rows whose last column, a key, is in the filter."""
    for batch in batches:
        at = np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64) >> np.uint64(64 - FILTER)
        yield batch.filter(pa.array((bits.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0))


def _allowed(batches, least: float):
    """The pairs (a, b) from rows (a, b, n, m, x, y) with the sets' sizes and wide parities that these don't
    rule out. The longer parities are folded to the length of the others, which are then by the same bits."""
    for batch in batches:
        a, b, *rest = batch.columns
        kept = []
        for k, (n, m, x, y) in enumerate(zip(*(c.to_pylist() for c in rest), strict=True)):
            x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
            while len(y) > len(x) > 0:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            if not len(x) or int(np.bitwise_count(x ^ y).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-9:
                kept.append(k)
        rows = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of digests whose sets have a Jaccard similarity of at least ``least``. Only texts
    that are in a pair are dealt to it, each read in whole; a filter keeps most others from the shuffle, and pairs
    that the wide parities rule out get none."""
    spark = pairs.sparkSession
    sizes = lambda c, n, x: reps.select(F.col("digest").alias(c), F.col("n").alias(n), F.col("wide").alias(x))
    pairs = pairs.join(sizes("a", "n", "x"), "a").join(sizes("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    pairs = written(pairs.mapInArrow(lambda b: _allowed(b, least), "a long, b long"), "pairs-allowed")
    both = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    key = F.xxhash64("doc_id", "mark").alias("key")
    wanted = written(reps.join(both, "digest").select("digest", F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark")), "similar-wanted")
    bits = spark.sparkContext.broadcast(_wanted(wanted.select(key)))
    some = texts.select("doc_id", "mark", "text", key).mapInArrow(lambda b: _filtered(b, bits), "doc_id long, mark long, text string, key long")
    texts = written(some.join(wanted, ["doc_id", "mark"]).select("digest", "text").dropDuplicates(["digest"]), "similar-texts")
    bits.unpersist()

    def run(batches):
        last, of_last = None, None
        for batch in batches:
            kept = []
            a, b, x, y = (batch.column(i) for i in range(4))
            for k in range(len(batch)):
                if b[k] != last:
                    last, of_last = b[k], shingles(y[k].as_py(), width)
                mine = shingles(x[k].as_py(), width)
                common = len(np.intersect1d(mine, of_last, assume_unique=True))
                if common >= least * (len(mine) + len(of_last) - common) - 1e-9:
                    kept.append(k)
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])

    side = lambda c: texts.select(F.col("digest").alias(c), F.col("text").alias(f"{c}_text"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    out = written(met.mapInArrow(run, "a long, b long"), "similar")
    drop_table(texts)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 22, least: float = 0.8, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(doc_id, component_id) of the ids that a chain of texts with a Jaccard similarity of at least
    ``least`` links to another; every link is verified on the whole sets of shingles.

    64 bits have no pigeonhole blocks for the distances that such texts show (10 bits on average at
    0.8), so candidates meet by shingles: of a set's n, the n - ceil(least n) + 1 of the least hashes, of
    which similar sets always share one. Two filters follow. A shingle that one set of a pair lacks flips one
    of its 512 parities, so more unlike parities than the similarity allows such shingles rule a pair out,
    without an error. SimHashes more than ``distance`` bits apart do so but for sets of fewer than SURE
    shingles; by a binomial estimate 22 bits leave out fewer than 1 in 10,000 of the pairs at 0.8, and
    fewer above. Large sets fill 512 parities, so theirs are more, and pairs are held against these before
    any text is dealt to them.

    First each set is compared with one of each bucket, the least; a group of near copies falls into one
    class by that, however large, with work in proportion to its size. Then sets of buckets that still hold
    several classes are compared with those of other classes, in pairs of chunks. That grows with the square
    of a bucket, so hashes that more than ``hot`` sets of such a bucket hold are put last in the order of all
    hashes, if copies of sets in their chunks come to an eighth of all, and the sets' first hashes are found
    anew: any one order will do, and in this one sets that only share common shingles don't meet.

    What was shuffled goes at the end of each query, and tables when their readers are done."""
    with tidied(docs.sparkSession):
        return _similar_groups(docs, id_col, text_col, width, distance, least, chunk, hot)


def _similar_groups(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int, least: float, chunk: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    texts = _marked(docs, id_col, text_col)
    rows = written(_sets(docs, id_col, text_col, width, least), "shingles")
    reps = written(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("at"), *[F.first(c).alias(c) for c in (*SKETCH[1:], "wide")]), "shingle-reps")
    ids = reps.select("digest", F.col("at.doc_id").alias("rep"))
    same = rows.select("digest", "doc_id").join(ids, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    shared = written(shared_hashes(rows.select("digest", F.expr("slice(first, 1, cast(p as int))").alias("first"))), "shingles-shared")
    size = lambda c: reps.select(F.col("digest").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in SKETCH[1:]])
    unlike = " + ".join(f"bit_count(a_{x} ^ b_{x})" for x in ODD)
    close = (
        f"least(a_n, b_n) >= {least} * greatest(a_n, b_n) - 1e-9 and {unlike} <= {(1 - least) / (1 + least)} * (a_n + b_n) + 1e-9"
        f" and (bit_count(a_fp ^ b_fp) <= {distance} or least(a_n, b_n) < {SURE})"
    )
    stars = shared.where("digest <> lo").select(F.col("digest").alias("a"), F.col("lo").alias("b")).distinct()
    stars = written(stars.join(size("a"), "a").join(size("b"), "b").where(close).select("a", "b"), "stars")
    edges = lambda true: true.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = written(same.unionByName(edges(_verified(stars, reps, texts, width, least))), "similar-edges")
    classes = components(found)
    linked = written(ids.join(classes, ids["rep"] == classes["node"], "left").select("digest", F.coalesce("component", "rep").alias("c")), "similar-classes")
    mixed = lambda rest: rest.groupBy("k").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    rest = shared.select("digest", "k").join(linked, "digest")
    common = np.empty(0, np.int64)
    for _ in range(ORDERS):
        more = mixed(rest).where(F.col("m") > hot).select("k", (F.col("m") * (F.ceil(F.col("m") / chunk) - 1)).alias("copies")).toArrow()
        k, copies = (more.column(c).to_numpy().astype(np.int64) for c in ("k", "copies"))
        new = ~np.isin(k, common)
        if copies[new].sum() <= shared.count() / 8:
            break
        drop_table(shared)
        common = np.concatenate([common, k[new]])
        shared = _rarely_shared(rows, texts, common, width, least)
        rest = shared.select("digest", "k").join(linked, "digest")
    drop_table(rows)
    mixed = mixed(rest).select("k", F.ceil(F.col("m") / chunk).alias("g"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Hashes that two classes share are all in mixed buckets, so these alone are looked at for earlier ones.
    own = Window.partitionBy("digest").orderBy("k")
    met = (
        rest.join(mixed, "k")
        .withColumns({c: F.lag("k", d, 0).over(own) for d, c in enumerate(BEFORE, 1)})
        .join(reps.select(*SKETCH), "digest")
        .withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("g")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .select("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "c", *SKETCH, *BEFORE)
        .repartition(parts, "k", "i", "j")
        .sortWithinPartitions("k", "i", "j")
    )
    pairs = met.mapInArrow(lambda batches: _met(batches, distance, least), "a long, b long").distinct()
    # Pairs of a set and the least of a bucket have been verified before.
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    drop_table(shared)
    more = written(found.unionByName(edges(_verified(pairs, reps, texts, width, least))), "similar-edges")
    drop_table(reps)
    return components(more).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, least: float | None = None) -> DataFrame:
    """docs with the smallest id of each near-duplicate group; rows without an id stay. Groups are those
    of fingerprints, or with ``least`` those of shingle sets of at least that similarity."""
    if least is None:
        groups = simhash_groups(docs, id_col, text_col, width, distance)
    else:
        groups = similar_groups(docs, id_col, text_col, width, distance, least)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
