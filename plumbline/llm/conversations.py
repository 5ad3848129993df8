"""Conversation structure repair: turns are aligned to an alternating grammar at the least cost of edits.

A conversation is repaired to role initials of the form (s?(ua)+)?.  Its rows are aligned to every feasible length of that
grammar string by one Wagner-Fischer table: read from the end, all lengths are the beginnings of one string, so that a cell is
(row, turns still to come) and the first row of the table holds the cost of each length.  Ukkonen bands keep the cells that
the cost of an incumbent allows.  All cheapest alignments, whatever their lengths, are traced at once, and the least audit in
ASCII order is kept.

Texts cross one shuffle and are never held: a first pass aligns facts of the rows (a few bytes and a digest each), a second one
streams the rows of each conversation past its audit.

Nulls: role and text count as one space, so that such a text is blank; null turns come first and do not count as gaps; null
ids are one conversation.  Rows of one turn are ordered by role and digest of the text, so equal rows need no order.  Empty
tables give no rows; further columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stash

#: Costs of the edits, and what a kept truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 29
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: Alignments that a task remembers (of conversations of up to REMEMBER_ROWS rows); short conversations repeat.
REMEMBER, REMEMBER_ROWS = 50_000, 64
WHITE = " \t\n\x0b\x0c\r"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class Alignment:
    """The banded table of one conversation.  Row i: cells (i, r) of the rows from i on and r turns still to come.

    plain: costs of rows i.. to the last r letters of the grammar; first: the same with a system turn still to come before
    them.  Both are arrays over r from low(i) on.
    """

    def __init__(self, initial: np.ndarray, forced: np.ndarray, truncated: np.ndarray):
        self.n, self.initial, self.forced = len(initial), initial, forced
        self.extra = np.where(truncated, TRUNCATED, 0)
        free = initial[~forced & ~truncated]
        # The incumbent deletes what is forced or truncated and gives the rest alternating roles.
        least = DELETE * int(self.n - len(free))
        body = free[1:] if len(free) > 1 and free[0] == SYSTEM else free
        even = len(body) // 2 * 2
        cost = DELETE * (len(body) - even) + REROLE * int((body[:even] != np.where(np.arange(even) % 2, ASSISTANT, USER)).sum())
        if len(body) < len(free) and not even:
            cost += DELETE
        slack = cost
        self.incumbent = least + cost
        rest = np.arange(self.n, -1, -1)
        must = np.append(np.cumsum(forced[::-1])[::-1], 0)
        may = np.append(np.cumsum((truncated & ~forced)[::-1])[::-1], 0)
        self.lows = np.maximum(0, rest - must - may - slack // DELETE - 1)
        self.highs = rest - must + slack // INSERT
        self.step = max(1, math.isqrt(self.n))

    def _at(self, cells: np.ndarray, low: int, start: int, stop: int) -> np.ndarray:
        """The cells start .. stop - 1 of a row that begins at low; NEVER outside of its band."""
        out = np.full(stop - start, NEVER, np.int32)
        a, b = max(start, low), min(stop, low + len(cells))
        if a < b:
            out[a - start : b - start] = cells[a - low : b - low]
        return out

    def _above(self, i: int, plain: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row i's costs of deleting, keeping and reroling in plain, of deleting and keeping in first, from row i + 1."""
        low, high, after = int(self.lows[i]), int(self.highs[i]) + 1, int(self.lows[i + 1])
        same, before = self._at(plain, after, low, high), self._at(plain, after, low - 1, high - 1)
        gone = same + DELETE
        keep = role = stay = np.full(high - low, NEVER, np.int32)
        if not self.forced[i]:
            fits = np.where(np.arange(low, high) % 2, ASSISTANT, USER) == self.initial[i]
            keep = np.where(fits, before + self.extra[i], NEVER)
            role = np.where(fits, NEVER, before + self.extra[i] + REROLE)
            if self.initial[i] == SYSTEM:
                r = np.arange(low, high)
                stay = np.where((r % 2 == 0) & (r >= 2), same + self.extra[i], NEVER)
        return gone, keep, role, self._at(first, after, low, high) + DELETE, stay

    def row(self, i: int, plain: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row i of the table from row i + 1."""
        gone, keep, role, out, stay = self._above(i, plain, first)
        base = np.minimum(np.minimum(gone, keep), role)
        ramp = INSERT * np.arange(len(base), dtype=np.int32)
        return np.minimum.accumulate(base - ramp) + ramp, np.minimum(np.minimum(out, stay), NEVER)

    def solve(self) -> tuple[int, str]:
        """Least cost and least audit of that cost.  Every step-th row of the table is kept, the others are made again."""
        low, high = int(self.lows[-1]), int(self.highs[-1]) + 1
        plain, first = INSERT * np.arange(low, high, dtype=np.int32), np.full(high - low, NEVER, np.int32)
        kept = {self.n: (plain, first)}
        for i in range(self.n - 1, -1, -1):
            plain, first = self.row(i, plain, first)
            if i % self.step == 0:
                kept[i] = plain, first
        even = np.arange(len(plain)) + int(self.lows[0])
        even = even % 2 == 0
        best = min(int(x[even].min(initial=NEVER)) for x in (plain, first))
        on, on_first = even & (plain == best), even & (first == best)
        audit: list[str] = []
        for begin in range(0, self.n, self.step):
            end = min(begin + self.step, self.n)
            table = {end: kept[end]}
            for i in range(end - 1, begin - 1, -1):
                table[i] = self.row(i, *table[i + 1])
            for i in range(begin, end):
                on, on_first = self._trace(i, table[i], table[i + 1], on, on_first, audit)
        audit.append("I" * (int(self.lows[-1]) + int(np.flatnonzero(on)[0])))
        return best, "".join(audit)

    def _trace(self, i: int, here: tuple, below: tuple, on: np.ndarray, on_first: np.ndarray, audit: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row's edits for all cheapest alignments with the audit so far; marks of those that go on at row i + 1.

        The marked cells share their audit, hence the row; the least letter that any of them offers is taken by all that do.
        """
        plain, first = here
        gone, keep, role, out, stay = self._above(i, *below)
        add = np.full(len(plain), NEVER, np.int32)
        add[1:] = plain[:-1] + INSERT
        low, after, width = int(self.lows[i]), int(self.lows[i + 1]), int(self.highs[i + 1]) + 1 - int(self.lows[i + 1])

        def move(marks: np.ndarray, less: int) -> np.ndarray:
            to = np.zeros(width, bool)
            at = np.flatnonzero(marks) + low - less - after
            to[at[(at >= 0) & (at < width)]] = True
            return to

        while True:
            cut, cut_first = on & (gone == plain), on_first & (out == first)
            if cut.any() or cut_first.any():
                audit.append("D")
                return move(cut, 0), move(cut_first, 0)
            more = on & (add == plain)
            if not more.any():
                break
            audit.append("I")
            on, on_first = np.append(more[1:], False), np.zeros(len(on_first), bool)
        same, system = on & (keep == plain), on_first & (stay == first)
        if same.any() or system.any():
            audit.append("K")
            return move(same, 1) | move(system, 0), np.zeros(width, bool)
        audit.append("R")
        return move(on & (role == plain), 1), np.zeros(width, bool)


def align(initial: np.ndarray, forced: np.ndarray, truncated: np.ndarray) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a conversation: initials (SYSTEM ..), rows to delete, other truncated rows."""
    return Alignment(initial, forced, truncated & ~forced).solve() if len(initial) else (0, "")


@functools.lru_cache(REMEMBER)
def _remembered(facts: bytes) -> tuple[int, str]:
    x = np.frombuffer(facts, np.uint8)
    return align(x & 3, x & 4 > 0, x & 8 > 0)


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by crc32 of conv_id:turn modulo 20, and present.

    0 drops the row (present is false, so that its conversation stays known), 1 empties the text, 2 removes its end marks, 3
    repeats the row, 4 sets the role to user.
    """
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(word[3], ".!?", "")).otherwise(word[3])
    out = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(word[2]).alias("role"), text.alias("text"), (fault != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"), digest.alias("digest"))


def _facts(role: Column, text: Column) -> Column:
    """A byte: the role's initial, 4 for a blank text, 8 for one without an end mark."""
    code = F.substring(role, 1, 1)
    initial = F.when(code == "s", SYSTEM).when(code == "u", USER).when(code == "a", ASSISTANT).otherwise(OTHER)
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return (initial + F.when(last == "", 4).otherwise(0) + F.when(last.isin("", ".", "!", "?"), 0).otherwise(8)).cast("int")


def _spans(ids: pa.Array) -> Iterator[tuple[int | None, int, int]]:
    """(id, first, end) of runs of equal ids."""
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy()
    cuts = np.flatnonzero((np.diff(value) != 0) | (valid[1:] != valid[:-1])) + 1 if len(ids) else []
    edges = [0, *np.asarray(cuts).tolist(), len(ids)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield (int(value[a]) if valid[a] else None), a, b


def _measure(turns: np.ndarray, known: np.ndarray, facts: np.ndarray, digests: list[bytes]) -> tuple:
    """The values of REPORT of one conversation, from its rows in order."""
    named = turns[known]
    gaps = int(named.max()) - int(named.min()) + 1 - len(np.unique(named)) if len(named) else 0
    seen: set[bytes] = set()
    again = np.zeros(len(facts), bool)
    for k, digest in enumerate(digests):
        again[k] = digest in seen
        seen.add(digest)
    blank = facts & 4 > 0
    repeated = again & ~blank
    cut = (facts & 8 > 0) & ~blank & ~repeated
    initial = facts & 3
    a, b = initial[:-1], initial[1:]
    legal = ((b == USER) & (a != OTHER) & (a != USER)) | ((a == USER) & (b == ASSISTANT))
    if len(facts) <= REMEMBER_ROWS:
        cost, audit = _remembered((initial | np.where(blank | repeated, 4, 0) | np.where(cut, 8, 0)).astype(np.uint8).tobytes())
    else:
        cost, audit = align(initial, blank | repeated, cut)
    return gaps, int(blank.sum()), int(repeated.sum()), int(cut.sum()), int((~legal).sum()), cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """conv_id and REPORT of every conversation, from facts of its rows; texts are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current: int | None = None
        out: list[tuple] = []

        def close() -> None:
            turns, known, facts, digests = (np.concatenate([h[k] for h in held]) if k < 3 else [d for h in held for d in h[3]] for k in range(4))
            out.append((current, *_measure(turns, known, facts, digests)))
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.string()], strict=True)], ["conv_id", *REPORT])
            out.clear()
            return batch

        for batch in batches:
            for key, a, b in _spans(batch.column(0)):
                if held and key != current:
                    close()
                current = key
                part = batch.slice(a, b - a)
                part = part.filter(part.column(4))
                turns = part.column(1)
                held.append((turns.fill_null(0).to_numpy(), turns.is_valid().to_numpy(zero_copy_only=False), part.column(2).to_numpy(), part.column(3).to_pylist()))
            if len(out) > 2000:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    facts = _ordered(rows).select("conv_id", "turn", _facts(F.col("role"), F.col("text")).alias("facts"), "digest", "present", "role")
    facts = facts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").select("conv_id", "turn", "facts", "digest", "present")
    return facts.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in REPORT[:-1]) + ", audit string")


class _Writer:
    """The digest of a repaired conversation, from its audit and its rows as they come."""

    ROLES = {"u": "user", "a": "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.due, self.sha, self.begun = audit, 0, "u", hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun, self.due = True, "a" if role[0] == "u" else "u"

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._write(role, text)
        elif edit == "R":
            self._write(self.ROLES[self.due], text)

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._write(self.ROLES[self.due], "")


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, present if some are to count as gone) -> conv_id, REPORT and repaired_sha256.

    conv_id: every one of the rows, gone or not.  repaired_sha256: of role:text of the repaired rows, joined by newlines.
    """
    found = stash(audits(rows), "conversation-audits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        out: list[str] = []
        writer: _Writer | None = None

        def flush(final: bool) -> pa.RecordBatch:
            k = len(out)
            batch = pa.RecordBatch.from_arrays([*(pa.array([h[c] for h in heads[:k]], pa.string() if c == 7 else pa.int64()) for c in range(8)), pa.array(out, pa.string())], ["conv_id", *REPORT, "repaired_sha256"])
            del heads[:k]
            out.clear()
            return batch

        for batch in batches:
            present, roles, texts = (batch.column(k).to_pylist() for k in (8, 9, 10))
            for k, there in enumerate(present):
                if there is None:  # the audit of the next conversation
                    if writer is not None:
                        writer.inserts()
                        out.append(writer.sha.hexdigest())
                    heads.append(tuple(batch.column(c)[k].as_py() for c in range(8)))
                    writer = _Writer(heads[-1][7])
                elif there:
                    writer.row(roles[k], texts[k])
            if len(out) > 2000:
                yield flush(False)
        if writer is not None:
            writer.inserts()
            out.append(writer.sha.hexdigest())
            yield flush(True)

    none = [F.lit(None).cast("long").alias(c) for c in REPORT[:-1]] + [F.lit(None).cast("string").alias("audit")]
    body = _ordered(rows).select("conv_id", *none, "present", "role", "text", "turn", "digest")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("present", "boolean"), ("role", "string"), ("text", "string"), ("turn", "long"), ("digest", "binary"))]
    both = found.select("conv_id", *REPORT, *blank).unionByName(body)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("present").isNotNull(), "turn", "role", "digest").drop("turn", "digest")
    return both.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in REPORT[:-1]) + ", audit string, repaired_sha256 string")
