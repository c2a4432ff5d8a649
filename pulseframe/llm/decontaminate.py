"""Benchmark decontamination: rare word pairs join passages to items, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import written

WORDS = re.compile(r"\w+")
#: Seeds that a text must share with an item, or all that must stay whole if those are fewer.
SEEDS = 3
#: Bits of the broadcast sketch of the benchmark's seeds, as a power of two: 8 MB whatever the benchmark.
SKETCH = 26
#: Rows whose keys are broadcast at most (8 bytes each); more of them are joined by a shuffle.
MOST_KEYS = 1_000_000
#: Words whose hashes, and items whose blocks, a worker remembers before it starts anew.
MEMO, MEMO_ITEMS = 300_000, 2_000
SEED = ("key", "goal", "hits", "code", "times", "by_word")
#: Scores of the alignment, and the least share of an item's own score that counts as a copy: with
#: these, about 80 % of the item's words in place and the others changed.
MATCH, MISMATCH, GAP, LEAST = 1.0, -0.5, -0.5, 0.65

def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Block:
    """Some items of a benchmark: their words, and the seeds to find them by."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[w] for w in words], dtype=np.int64) for _, words in items]
        width = len(self.vocabulary) + 1
        self.pairs = _postings([x[:-1] * width + x[1:] for x in self.items])
        self.words = _postings(self.items)
        self._needs: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def needs(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By item what every alignment of score ``least`` holds: pairs of neighbouring words, words, and
        the most words of a text that it spans.

        With f = (1 - least) * n to lose of n words, a lost neighbourhood costs half a word at least (an
        insertion; a changed or missing word costs 1.5 for two, a missing end 1 for one), so n - 1 - 2 f
        stay whole, and 2 f words at most are inserted. Items of which no pair need stay are sought by
        words, of which at least the score is matched."""
        if least not in self._needs:
            n = np.array([len(x) for x in self.items], dtype=np.int64)
            lost = _lost(n, least)
            words = np.maximum(np.ceil(least * n - 1e-9).astype(np.int64), 1)
            self._needs[least] = np.maximum(n - 1 - lost, 0), words, n + lost
        return self._needs[least]

    def _regions(self, ids: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): stretches of a text outside of which no alignment of score ``least`` lies."""
        pairs, words, spans = self.needs(least)
        width = len(self.vocabulary) + 1
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        found = [(pairs, both, ids[both] * width + ids[both + 1], self.pairs)]
        if (pairs == 0).any():
            known = np.flatnonzero(ids)
            found.append((np.where(pairs == 0, words, 0), known, ids[known], self.words))
        for need, where, codes, (keys, starts, members) in found:
            if not len(codes) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == codes)
            n = starts[at[hit] + 1] - starts[at[hit]]
            if not n.sum():
                continue
            places = np.repeat(where[hit], n)
            items = members[np.arange(n.sum()) + np.repeat(starts[at[hit]] - (np.cumsum(n) - n), n)]
            counts = np.bincount(items, minlength=len(need))
            enough = np.flatnonzero((need > 0) & (counts >= need))
            if not len(enough):
                continue
            sought = np.zeros(len(need), bool)
            sought[enough] = True
            some = sought[items]
            items, places = items[some], places[some]
            order = np.argsort(items, kind="stable")
            items, places = items[order], places[order]
            ends = np.searchsorted(items, enough, side="right")
            for k, a, b in zip(enough.tolist(), np.searchsorted(items, enough).tolist(), ends.tolist(), strict=True):
                mine, more, span = places[a:b], int(need[k]) - 1, int(spans[k])
                near = np.flatnonzero(mine[more:] - mine[: len(mine) - more] < span)
                if not len(near):
                    continue
                lo, hi = np.maximum(mine[near] - span, 0), np.minimum(mine[near + more] + span + 1, len(ids))
                cuts = np.flatnonzero(lo[1:] > hi[:-1]) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lo)], strict=True):
                    yield k, int(lo[i]), int(hi[j - 1])

    def matches(self, text: str | None, least: float = LEAST) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, end word) of the items that a whole text holds a copy of; of
        several copies of an item the best, the first on ties."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for k, a, b in self._regions(ids, least):
            if best.get(k, (0.0,))[0] >= 1.0:
                continue
            score, first, end = align(self.items[k], ids[a:b])
            if score > best.get(k, (0.0,))[0]:
                best[k] = score, a + first, a + end
        return [(self.ids[k], round(float(s), 6), int(a), int(b)) for k, (s, a, b) in best.items() if s >= least]


def _postings(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes, where the items of each begin, and the items that hold it."""
    codes = [np.unique(x) for x in items]
    code, item = np.concatenate(codes), np.repeat(np.arange(len(items)), [len(x) for x in codes])
    order = np.argsort(code, kind="stable")
    keys, starts = np.unique(code[order], return_index=True)
    return keys, np.append(starts, len(code)), item[order]


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of an item's words with a window: its score as a share of the item's own
    score, and where it begins and ends in the window. A row of the table at a time."""
    n = len(window)
    if not n or not len(item):
        return 0.0, 0, 0
    steps = GAP * np.arange(n + 1)
    h, origin = np.zeros(n + 1), np.arange(n + 1)
    best, where = 0.0, (0, 0)
    for w in item:
        diag = h[:-1] + np.where(window == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        new, src = np.zeros(n + 1), np.arange(n + 1)
        take = diag >= up
        step = np.where(take, diag, up)
        from_ = np.where(take, origin[:-1], origin[1:])
        positive = step > 0
        new[1:] = np.where(positive, step, 0.0)
        src[1:] = np.where(positive, from_, src[1:])
        # Gaps in the item: the best cell to the left less its distance.
        lead = new - steps
        top = np.maximum.accumulate(lead)
        arg = np.maximum.accumulate(np.where(lead == top, np.arange(n + 1), 0))
        reached = top + steps
        better = (reached > new) & (reached > 0)
        new, src = np.where(better, reached, new), np.where(better, src[arg], src)
        h, origin = new, src
        j = int(h.argmax())
        if h[j] > best:
            best, where = float(h[j]), (int(origin[j]), j)
    return best / (MATCH * len(item)), *where


def _lost(n: np.ndarray | int, least: float):
    """Neighbourhoods of an item of n words that an alignment of score ``least`` can break at most."""
    return np.floor(2 * (1 - least) * np.asarray(n) + 1e-9).astype(np.int64)


def _hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    out = [memo.get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                if len(memo) >= MEMO:
                    memo.clear()
                out[i] = memo[words[i]] = xxhash.xxh64_intdigest(words[i].encode("utf-8", "replace"))
    return np.array(out, dtype=np.uint64)


def _pair_codes(h: np.ndarray) -> np.ndarray:
    return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _seed_rows(batches, least: float):
    """From (key, text) of items (key, goal, hits, code, times, by_word): each distinct seed of an item, with how often
    it comes in it, the places that the item's seeds are to cover, and how many of them a copy holds.

    Of n - 1 pairs all but ``lost`` stay whole in a copy. So of the rarest pairs that cover lost + s places
    it holds s. Items of which no pair need stay are sought by words."""
    memo: dict[str, int] = {}
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _hashes(words_of(text), memo)
            n = len(h)
            if not n:
                continue
            codes, whole = _pair_codes(h), n - 1 - int(_lost(n, least))
            by_word = whole <= 0
            if by_word:
                codes, whole = h, max(int(np.ceil(least * n - 1e-9)), 1)
            hits = min(SEEDS, whole)
            for code, times in zip(*np.unique(codes.view(np.int64), return_counts=True), strict=True):
                out.append((key, len(codes) - whole + hits, hits, int(code), int(times), int(by_word)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=list(SEED))


def _sketch(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed, by the first bits of its code. What comes to the driver is bounded by the
    sketch's own size."""
    at = F.shiftrightunsigned("code", 64 - SKETCH).alias("at")
    words = seeds.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (SKETCH - 6), dtype=np.uint64)
    for r in words.toLocalIterator():
        out[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


def _hit_rows(batches, sketch, by_words: bool):
    """From (row, text): the distinct codes of a text that the sketch holds, of texts with any."""
    memo: dict[str, int] = {}
    for batch in batches:
        bits, rows, found = sketch.value, [], [np.empty(0, np.int64)]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _hashes(words_of(text), memo)
            codes = np.concatenate([_pair_codes(h), h]) if by_words else _pair_codes(h)
            at = codes >> np.uint64(64 - SKETCH)
            hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            codes = np.unique(codes[hit.astype(bool)].view(np.int64))
            if len(codes):
                rows.append(row)
                found.append(codes)
        ends = np.cumsum([0, *map(len, found[1:])])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], names=["row", "codes"])


def _aligned(batches, least: float):
    """From (row, doc_id, text, item_id, item) the items that the text holds a copy of."""
    known: dict[str, Block] = {}
    for batch in batches:
        out = []
        for row, doc, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if item not in known:
                if len(known) >= MEMO_ITEMS:
                    known.clear()
                known[item] = Block([(0, words_of(item))])
            out += [(row, doc, item_id, *m[1:]) for m in known[item].matches(text, least)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["row", "doc_id", "item_id", "score", "first_word", "end_word"])


def _bounded(keys: DataFrame) -> DataFrame:
    """A written frame of keys, to be broadcast if its rows are few enough."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text); row is a hash of both others, so that equal rows share it."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(_row(id_col, text_col).alias("row"), doc.alias("doc_id"), text.alias("text"))


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _found(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, least: float, item_col: str = "item_id") -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    items = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).distinct()
    items = written(items.withColumn("key", F.xxhash64("item_id", "item")), "items")
    seeds = written(items.select("key", "item").mapInArrow(lambda b: _seed_rows(b, least), ", ".join(f"{c} long" for c in SEED)), "seeds")
    by_words = bool(seeds.where("by_word = 1").limit(1).count())
    sketch = spark.sparkContext.broadcast(_sketch(seeds))
    rows = _rows(docs, id_col, text_col)
    hits = written(rows.select("row", "text").mapInArrow(lambda b: _hit_rows(b, sketch, by_words), "row long, codes array<long>"), "hits")
    codes = hits.select("row", F.explode("codes").alias("code"))
    # The rarest seeds of each item until they cover as many places as a copy must hold some of.
    often = codes.join(seeds.select("code").distinct(), "code").groupBy("code").agg(F.count("*").alias("texts"))
    by_rarity = Window.partitionBy("key").orderBy(F.coalesce("texts", F.lit(0)), "code")
    before = F.sum("times").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1))
    rare = written(seeds.join(often, "code", "left").withColumn("before", F.coalesce(before, F.lit(0))).where("before < goal").select("key", "hits", "code", "times"), "rare")
    near = codes.join(rare, "code").groupBy("row", "key").agg(F.sum("times").alias("held"), F.first("hits").alias("hits")).where("held >= hits")
    near = written(near.select("row", "key").join(items, "key").select("row", "item_id", "item"), "near")
    texts = rows.join(_bounded(written(near.select("row").distinct(), "near-rows")), "row", "left_semi")
    met = texts.join(near, "row").select("row", "doc_id", "text", "item_id", "item")
    best = met.mapInArrow(lambda b: _aligned(b, least), "row long, doc_id long, item_id long, score double, first_word long, end_word long")
    return best


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): one row for each row of docs and item of the
    benchmark that it holds a copy of, exact, edited or paraphrased in few words.

    The documents are read once against a sketch of the benchmark's word pairs, of fixed size; the pairs
    that they share join them to the items by their rarest seeds, and texts that share enough with an item
    are aligned with it, each read in whole. No alignment of score ``least`` is missed. Words are runs of
    letters, digits and underscores in lower case. Null and empty texts hold nothing; a row without an id
    gives rows without one. Items without an id or words are left out; items that share an id are
    items of their own, equal ones one. An empty benchmark or no documents: no rows."""
    return _found(docs, bench, id_col, text_col, least).drop("row")


def decontaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs without the rows that hold a copy of a benchmark item."""
    gone = written(_found(docs, bench, id_col, text_col, least).select(F.col("row").alias("__row")).distinct(), "contaminated")
    return docs.join(_bounded(gone), _row(id_col, text_col) == F.col("__row"), "left_anti")
