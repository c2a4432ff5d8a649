"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by phrase."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import written

#: Words of a phrase at most, its least count, the share in per cent of its count at which a longer phrase
#: swallows it, and phrases of a language in the report.
WIDEST, LEAST, SWALLOWED, TOP = 3, 10, 50, 2000
#: Words whose suffix array a task holds at a time.
SHARD_WORDS = 1_500_000
#: Bits of the filter of frequent pairs (2 to this power, 16 MB). The fuller it is the more phrases go to the
#: shuffle; it changes no count.
FILTER = 27
#: Words and the signs that end a piece, in texts whose A-Z are lower-cased.
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
ENDS = [bytes([x]) for x in b".,;:!?\x0a\x0b\x0c\x0d"]


class Ids(dict):
    """Ids of words in the order of their coming; signs that end a piece have 0."""

    def __init__(self):
        super().__init__(dict.fromkeys(ENDS, 0))
        self.words: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Shard:
    """Texts of one language as word ids, each text ended by a 0."""

    def __init__(self):
        self.ids, self.parts, self.size = Ids(), [], 0

    def add(self, text: str) -> None:
        tokens = TOKEN.findall(text.encode("utf-8", "replace").lower())  # of bytes, lower() changes A-Z alone
        tokens.append(b"\n")
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def array(self, ahead: int) -> np.ndarray:
        """The ids, with 0 behind for those that look ahead."""
        whole = np.concatenate([*self.parts, np.zeros(ahead, np.int64)])
        self.parts = []
        return whole


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of the suffixes that begin there, by their first ``depth`` ids at least.

    Prefix doubling: ranks by the first k ids, paired with those k places on, give the ranks by 2k."""
    rank, k, order = ids, 1, None
    while k < depth or order is None:
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - k] = rank[k:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key)
        key = key[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, k = new, 2 * k
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order how many first words, ``depth`` at most, it shares with the one before; words
    end at the first 0."""
    same, lcp = np.ones(len(order) - 1, bool), np.zeros(len(order), np.int64)
    for k in range(depth):
        w = ids[order + k] if k else ids[order]
        same &= (w[1:] == w[:-1]) & (w[1:] > 0)
        lcp[1:] += same
    return lcp


def phrases(ids: np.ndarray, widest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for n of 1 to ``widest``: a place of each distinct phrase of n words, and how often it comes.

    A phrase is an interval of the suffix array, within which the common prefixes have n words or more."""
    order = suffix_array(ids, widest)
    order = order[ids[order] > 0]
    if not len(order):
        return
    lcp = common_prefixes(ids, order, widest)
    for n in range(1, widest + 1):
        whole = np.ones(len(order), bool)
        for k in range(1, n):
            whole &= ids[order + k] > 0
        starts = np.flatnonzero(whole & (lcp < n))
        counts = np.add.reduceat(whole, starts, dtype=np.int64) if len(starts) else starts
        yield n, order[starts], counts


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[str, Shard]]:
    """The texts of a task in shards of one language; all are let go once they hold ``most`` words together."""
    held: dict[str, Shard] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            held.setdefault(lang.as_py(), Shard()).add(text.as_py())
            if sum(s.size for s in held.values()) >= most:
                yield from held.items()
                held = {}
    yield from held.items()


def _pair_hashes(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, lang: str) -> np.ndarray:
    """64 bits of the language and the two words at each place."""
    h = (hashes[ids[at]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(32))) + hashes[ids[at + 1]]) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _sliced(columns: list[pa.Array], names: list[str], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for k in range(0, len(whole), rows):
        yield whole.slice(k, rows)


def _pair_rows(batches, most: int) -> Iterator[pa.RecordBatch]:
    """(pair, n): the hash of each pair of words of a shard, and how often it comes."""
    for lang, shard in _shards(batches, most):
        ids = shard.array(4)
        for n, at, counts in phrases(ids, 2):
            if n == 2:
                pair = _pair_hashes(ids, _word_hashes(shard.ids.words), at, lang).view(np.int64)
                yield from _sliced([pa.array(pair), pa.array(counts)], ["pair", "n"])


def _phrase_rows(batches, bits, most: int, widest: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n): the counts of a shard's words, and of those of its phrases all of whose pairs are in the filter;
    under 0 words all words of the shard."""
    names = ["lang", "words", "phrase", "n"]
    for lang, shard in _shards(batches, most):
        ids = shard.array(2 * widest + 2)
        words, hashes = pa.array(shard.ids.words, pa.binary()), _word_hashes(shard.ids.words)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int((ids > 0).sum())])], names=names)
        for n, at, counts in phrases(ids, widest):
            for k in range(n - 1):
                hit = _in_filter(bits.value, _pair_hashes(ids, hashes, at + k, lang))
                at, counts = at[hit], counts[hit]
            parts = [words.take(pa.array(ids[at + k])) for k in range(n)]
            phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
            yield from _sliced([pa.repeat(lang, len(at)), pa.repeat(pa.scalar(n, pa.int32()), len(at)), phrase, pa.array(counts)], names)


def _in_filter(bits: np.ndarray, pair: np.ndarray) -> np.ndarray:
    at = pair >> np.uint64(64 - FILTER)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _filter(pairs: DataFrame) -> np.ndarray:
    """One bit for each frequent pair by the first bits of its hash; what comes to the driver is bounded by the
    filter's own size."""
    at = F.shiftrightunsigned("pair", 64 - FILTER)
    words = pairs.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, widest: int = WIDEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, phrase, n): the phrases of up to ``widest`` words that come ``least`` times or more in a language,
    by number of words, and under 0 words how many words the language has.

    Texts are read twice. First each task builds suffix arrays of its shards by pairs of words, and the pairs'
    hashes are counted over all shards. Then it builds them by whole phrases, and those whose pairs all come
    often enough (a longer phrase comes no more often than its parts) are merged by their words: the counts of
    those are exact, and the rest of the phrases, most of which come once, are never shuffled. A phrase
    that a third of all texts hold is one row for each shard."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    pairs = rows.mapInArrow(lambda b: _pair_rows(b, shard_words), "pair long, n long")
    frequent = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bits = spark.sparkContext.broadcast(_filter(frequent))
    found = rows.mapInArrow(lambda b: _phrase_rows(b, bits, shard_words, widest), "lang string, words int, phrase string, n long")
    merged = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return written(merged.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, k, l, r, score): each phrase of two words or more at its lowest-scoring cut."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    words = F.split("phrase", " ", -1)
    cut = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.array_join(F.slice("w", 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " "))
    for part, name in (("first", "l"), ("rest", "r")):
        known = counts.where("words > 0").select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cut = cut.join(known, ["lang", part])
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), wide("l") * wide("r"))
    best = cut.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("lang", "words", "phrase", "a", "c.k", "c.l", "c.r", "c.score")


def not_swallowed(found: DataFrame, share: int = SWALLOWED) -> DataFrame:
    """Without the phrases inside a longer one that comes at least ``share`` per cent as often."""
    n, w = F.col("words"), F.split("phrase", " ", -1)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    longer = found.where("words > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("top"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("top").alias("top"))
    out = found.join(longer, ["lang", "phrase"], "left")
    return out.where(F.col("top").isNull() | (100 * F.col("top") < share * F.col("a"))).drop("top")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, widest: int = WIDEST, share: int = SWALLOWED, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A text's A-Z are lower-cased; it is cut at .,;:!? and line ends into pieces, those at spaces and tabs into words.
    A phrase is 2 to ``widest`` words that follow each other in a piece, a times in its language, ``least`` or more; its
    score is 1,000,000 a a / (l r), floored, at the cut with the lowest (on ties the shortest first part), l
    and r being the counts of the parts and n that of all words. Phrases inside a longer one that comes ``share`` per
    cent as often or more are left out. Order: score and a from the largest, then the phrase's bytes.

    Counts are over whole texts of all rows, repeated rows and ids included; null texts have no words, a null
    language is ``und``, other columns don't matter. Products are decimals of 38 digits. No words: no rows."""
    counts = phrase_counts(docs, text_col, lang_col, least, widest, shard_words)
    found = not_swallowed(scored(counts), share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
