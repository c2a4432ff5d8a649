"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Fixed values of byte-level BPE: the pieces that a text is cut into before merging.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space that white space precedes, or that white space or the end follows.
LOOSE = regex.compile(r"\s (?=\s|\Z)|  | \Z")
#: Chunks and pieces whose counts a worker remembers, each; beyond that it starts anew.
MEMO = 1_000_000
MEMO_BYTES = 64


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: bytes that print stand for themselves, the
    others follow from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(extra)) for b in range(256)]


class Counter:
    """Counts of one vocabulary file (tokenizers' JSON, byte-level BPE)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.symbols = _byte_symbols()
        self.added = [a["content"] for a in d.get("added_tokens", [])]
        self.cut = regex.compile("|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.memo: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merges(self, piece: str) -> int:
        """Tokens of one piece: its bytes less the merges made, always the lowest-ranked adjacent
        pair first, the leftmost on ties. The heap holds pairs by rank and place; the list of
        neighbours skips symbols that have been merged away. O(n log n)."""
        part = [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        n, rank = len(part), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if i < n else n
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has changed since
            part[i], part[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            count -= 1
            if (k := left[i]) >= 0 and (r := rank.get((part[k], part[i]))) is not None:
                heapq.heappush(heap, (r, k, part[k], part[i]))
            if (k := right[i]) < n and (r := rank.get((part[i], part[k]))) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        return count

    def _whole(self, chunk: str) -> int:
        """Chunks differ in the signs after a word more than in their words, so words are remembered too."""
        memo, total = self.pieces, 0
        for x in PIECES.findall(chunk):
            n = memo.get(x)
            if n is None:
                n = self.merges(x)
                if len(x) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[x] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        """Between a sign and a space that one sign follows a new piece always begins, so texts are
        cut there and the chunks' counts remembered. Texts with loose spaces are cut by the pattern."""
        memo = self.memo
        if LOOSE.search(text):
            chunks = PIECES.findall(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first] if first else []
            chunks += [" " + x for x in rest]
        total = 0
        for x in chunks:
            n = memo.get(x)
            if n is None:
                n = self._whole(x)
                if len(x) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[x] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        special = sum(1 for _ in self.cut.finditer(text))
        return special + sum(self._plain(x) for x in self.cut.split(text) if x)


@lru_cache(maxsize=2)
def _counter(name: str) -> Counter:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Counter(f.read())


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary: path of the tokenizer's JSON file, shipped to executors once as a Spark file. The
    count equals the library's with its defaults: strings of added tokens inside a text count as one
    token each, nothing is added or cut off. Null and empty texts: 0 bytes, 0 tokens. Columns that
    are named like the new ones are replaced. No documents: no rows."""
    spark = docs.sparkSession
    ship(spark)
    name = vocabulary.rpartition("/")[2]
    if name not in {x.rpartition("/")[2] for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(vocabulary)

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        count = _counter(name).count
        return pa.array([count(t) for t in texts.to_pylist()], pa.int64())

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
        .withColumn("n_tokens", n_tokens(text))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
