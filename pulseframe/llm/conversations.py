"""Repair of conversations: the cheapest edits to alternating turns, found by A* on the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

#: Costs of edits; a truncated row that stays is charged beside them.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and signs of a conversation that a task holds at a time.
BLOCK_ROWS, BLOCK_SIGNS = 1024, 4 << 20
#: White space, signs that end a text, and pairs of neighbouring role initials that are legal.
SPACE, ENDS, LEGAL = r"\x20\x09-\x0D", ".!?", ("su", "ua", "au")
#: What role initials lead from state to state of (s?(ua)+)?: begun, a system turn, a user's, an assistant's.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def _step(state: int, initial: str) -> int | None:
    """An empty role has no initial, and so leads nowhere else."""
    return STEPS.get((state, initial)) if initial else state


@dataclass
class Path:
    """The cheapest way to a state at the end of a block: cost, edits as links back, and the repaired text's
    hash so far."""

    cost: int = 0
    edits: tuple | None = None
    hashed: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    empty: bool = True

    def audit(self) -> str:
        parts, link = [], self.edits
        while link:
            link, part = link
            parts.append(part)
        return "".join(reversed(parts))


def search(rows: list[tuple[str, int]], starts: list[tuple[int, int]], last: bool) -> list[tuple[int, int, int, str]]:
    """(state, start, cost, edits), from the ASCII-least edits on: the cheapest ways over some rows of a conversation.

    rows: (role initial, fault), fault 0 for none, 1 for rows that must go, 2 for truncated ones. starts: (state, cost)
    of the ways so far, from the ASCII-least on. Not last: one way to each state that can be reached, none ending in an
    insertion, as those stand before a row. Last: the way to an accepting state.

    A* keyed by cost plus heuristic and then by edits, of which the start is the first sign. The heuristic is
    the sum of what the rows left cost at least: a deletion for those that must go, and for truncated ones the
    cheaper of a deletion and the charge. It never falls by more than an edit costs, so the first way to a place is the
    cheapest, and of equal ones that with the least edits: all their beginnings have keys that are less."""
    n, least = len(rows), [0] * (len(rows) + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (0, DELETE, min(DELETE, TRUNCATED))[rows[i][1]]
    heap = [(cost + least[0], chr(48 + k), 0, state) for k, (state, cost) in enumerate(starts)]
    heapq.heapify(heap)
    done, found = set(), []
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = f - least[i]
        if i == n and (not last or state in ACCEPTING):
            found.append((state, ord(audit[0]) - 48, cost, audit[1:]))
            if last:
                break
        if i == n and not last:
            continue
        for initial in ROLES:
            if (to := _step(state, initial)) is not None:
                heapq.heappush(heap, (f + INSERT, audit + "I", i, to))
        if i == n:
            continue
        (initial, fault), rest = rows[i], least[i + 1]
        heapq.heappush(heap, (cost + DELETE + rest, audit + "D", i + 1, state))
        if fault == 1:
            continue
        charge = cost + (TRUNCATED if fault == 2 else 0) + rest
        if (to := _step(state, initial)) is not None:
            heapq.heappush(heap, (charge, audit + "K", i + 1, to))
        for new in ROLES:
            if (to := _step(state, new)) is not None:
                heapq.heappush(heap, (charge + REROLE, audit + "R", i + 1, to))
    return sorted(found, key=lambda x: (x[1], x[3]))


def edited(rows: list[tuple[str, str]], edits: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows after edits from a state on."""
    at = 0
    for e in edits:
        role, text = ("", "") if e == "I" else rows[at]
        at += e != "I"
        if e == "D":
            continue
        if e != "K":
            new = next(x for x in ROLES if _step(state, x) is not None)
            role = ROLES[new]
        state = _step(state, role[:1])
        yield role, text


class Conversation:
    """Repairs a conversation whose rows come in order, block by block: at a block's end there is one way for
    each state, with the hash of what it keeps, so texts are held for one block only."""

    def __init__(self, block_rows: int = BLOCK_ROWS):
        self.block_rows = block_rows
        self.ways: list[tuple[int, Path]] = [(0, Path())]
        self.rows: list[tuple[str, str]] = []
        self.codes: list[tuple[str, int]] = []
        self.signs = 0

    def add(self, role: str, text: str, fault: int) -> None:
        if len(self.rows) >= self.block_rows or self.signs >= BLOCK_SIGNS:
            self._block(False)
        self.rows.append((role, text))
        self.codes.append((role[:1], fault))
        self.signs += len(text)

    def _block(self, last: bool) -> None:
        new = []
        for state, start, cost, edits in search(self.codes, [(s, p.cost) for s, p in self.ways], last):
            begun, path = self.ways[start]
            hashed, empty = path.hashed.copy(), path.empty
            for role, text in edited(self.rows, edits, begun):
                hashed.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                empty = False
            new.append((state, Path(cost, (path.edits, edits), hashed, empty)))
        self.ways, self.rows, self.codes, self.signs = new, [], [], 0

    def end(self) -> Path:
        self._block(True)
        return self.ways[0][1]


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _repairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (conv, turn, role, text, fault) of whole conversations, fault null for rows that the damage took:
    a row for each conversation."""
    at, conv, out = None, None, []

    def closed() -> tuple:
        path = conv["rows"].end()
        gaps = conv["last"] - conv["first"] + 1 - conv["turns"] if conv["turns"] else 0
        return at, gaps, *conv["faults"], conv["illegal"], path.cost, path.audit(), path.hashed.hexdigest()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", *NAMES])

    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    for batch in batches:
        for key, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if conv is None or key != at:
                if conv is not None:
                    out.append(closed())
                at = key
                conv = {"rows": Conversation(), "first": None, "last": None, "turns": 0, "faults": [0, 0, 0], "illegal": 0, "before": None}
            if fault is None:
                continue
            if turn is not None and turn != conv["last"]:
                conv["first"] = turn if conv["first"] is None else conv["first"]
                conv["last"], conv["turns"] = turn, conv["turns"] + 1
            if fault:
                conv["faults"][fault - 1] += 1
            if conv["before"] is not None and conv["before"] + role[:1] not in LEGAL:
                conv["illegal"] += 1
            conv["before"] = role[:1]
            conv["rows"].add(role, text, (0, 1, 1, 2)[fault])
        if out:
            yield batch_of(out)
            out = []
    if conv is not None:
        yield batch_of([closed()])


def damaged(convs: DataFrame, key: Column, turn: Column) -> DataFrame:
    """convs with role and text after a damage that the key's and turn's checksum chooses, and ``copy``: null for rows that
    it takes, 1 for a row that it repeats."""
    how = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(how == 0, F.array(F.lit(None).cast("int"))).when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return convs.withColumns({"text": text, "role": F.when(how == 4, "user").otherwise(F.col("role")), "copy": F.explode(copies)})


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, copy) with ``fault``: 1 blank, 2 duplicate, 3 truncated, else 0; null without copy."""
    order = [F.col("turn").asc_nulls_first(), "copy"]
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text", F.col("copy").isNull()).orderBy(*order)) > 1
    said = F.rtrim(F.regexp_replace("text", f"[{SPACE}]", " "))
    fault = F.when(F.col("copy").isNull(), None).when(said == "", 1).when(seen, 2).when(~F.right(said, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    return rows.withColumn("fault", fault.cast("int"))


def _canonical(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text), nulls of role and text as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return convs.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"))


def repaired(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    Rows stand by turn, nulls first, of equal turns by role and text. A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated (last sign that is no white space not one of .!?). gaps: turns that lack between the first
    and the last; illegal: neighbours whose role initials don't follow each other. Edits: keep, rerole to user or assistant
    (1), delete (2; blank and duplicate rows must go), insert an empty turn of either (5); a truncated row that stays
    costs 5 more. audit: the initials of the cheapest edits that give role initials (s?(ua)+)?, of equal ones the
    ASCII-least. repaired_sha256: of the repaired ``role:text`` lines.

    damage: the rows are damaged first, each as its checksum says, for tests of the repair. A conversation that loses all rows so
    has zeros, no edits and the hash of nothing. Null conversation ids are one conversation, null roles and texts one space; rows may
    repeat; other columns don't matter. No conversations: no rows.

    A conversation's rows pass one task in order, as a hash of its whole text must; the task holds a block of them
    and an edit's letter for each row."""
    ship(convs.sparkSession)
    rows = _canonical(convs, conv_col, turn_col, role_col, text_col)
    rows = damaged(rows, F.col("conv"), F.col("turn")) if damage else rows.withColumn("copy", F.lit(0))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault") == 2, F.col("copy")]
    rows = with_faults(rows.repartition("conv")).sortWithinPartitions(*order)
    out = rows.select("conv", "turn", "role", "text", "fault").mapInArrow(_repairs, f"conv string, {FIELDS}")
    return out.select(F.col("conv").cast(convs.schema[conv_col].dataType).alias(conv_col), *NAMES)


def repaired_rows(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, role, text, edit): the turns of repaired conversations, with the edit that made each.

    The audit's letters are dealt back to the rows by their places; a turn's role follows from its place, as
    those after a system turn alternate."""
    audits = repaired(convs, conv_col, turn_col, role_col, text_col).select(F.col(conv_col).cast("string").alias("conv"), "audit")
    letters = audits.select("conv", F.posexplode(F.split("audit", "")).alias("position", "edit")).where("edit <> ''")
    own = Window.partitionBy("conv").orderBy("position")
    letters = letters.withColumn("place", F.when(F.col("edit") != "I", F.count_if(F.col("edit") != "I").over(own)))
    rows = _canonical(convs, conv_col, turn_col, role_col, text_col)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    both = letters.join(rows.drop("turn"), letters["conv"].eqNullSafe(rows["conv"]) & (letters["place"] == rows["place"]), "left").drop(rows["conv"]).drop("place")
    both = both.where("edit <> 'D'").withColumn("position", F.row_number().over(own).cast("long") - 1)
    counted = (F.col("edit") != "K") | (F.col("role") != "")
    both = both.withColumn("turn", F.count_if(counted).over(own) - 1)
    system = F.bool_or(counted & (F.col("edit") == "K") & (F.col("turn") == 0) & F.startswith("role", F.lit("s"))).over(Window.partitionBy("conv"))
    turn = F.col("turn") - system.cast("int")
    role = F.when(F.col("edit") == "K", F.col("role")).when(turn % 2 == 0, "user").otherwise("assistant")
    return both.select(F.col("conv").cast(convs.schema[conv_col].dataType).alias(conv_col), "position", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def digest(convs: DataFrame) -> DataFrame:
    return repaired(convs, damage=True)
