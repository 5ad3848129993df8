"""Best-fit packing of documents into sequences by bin completion.

Documents are tokenised and cut into pieces of at most CAPACITY tokens.  Packing needs only how many pieces there are of
each length, at most CAPACITY numbers whatever the corpus, so there is one global problem: a branch-and-bound completes the
bin of the largest remaining piece, with all undominated fillings in order of waste, pruned by the waste that a better
packing may still have, with best-fit-decreasing solutions as incumbents.  A step repeats its filling as often as
the counts allow (and fewer times on the way back), so the number of steps does not follow the corpus.

The search ends when it meets the lower bound (an optimum), when it has tried everything (an optimum), or after STEPS nodes
of the enumeration; then the descent at hand is finished by best fit and the better of both solutions stays.  Steps are
counted, not timed, so reruns agree on any machine.

The solution is a list of patterns with multiplicities.  A piece's rank among those of its length (counted in cells of a
hash of its id, so no task ranks more than a cell) says which slot of which pattern it takes.

A null or empty text is one piece: the end mark.  Texts of any length are cut whole.  Rows with equal ids and texts are
packed each for itself.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WordHasher, stash, text_blocks

CAPACITY, END = 2048, 0
#: Pieces of a cell, about: pieces are ranked within cells of a length, at least CELLS of them.
CELL_PIECES, CELLS = 500_000, 256
#: Nodes of the enumeration of fillings that the search visits at most.
STEPS = 200_000
#: Bytes of text that are tokenised at a time: each block adds its new words to the memory once.
WORD_BLOCK = 1 << 20
#: Words whose ids a worker remembers, before it starts over.
CACHE_WORDS = 500_000


# ---------------------------------------------------------------- tokens


class Tokens:
    """Token ids of many texts at once, equal to those of the tokenizer.

    The tokenizer lower-cases, splits into words by one regex (runs of letters, single digits, runs of other signs, English
    contractions) and encodes each word by itself.  For texts of Latin letters the runs are found here on whole blocks of
    bytes, and each distinct word is encoded once; any other text goes through the tokenizer whole.
    """

    SPACE, LETTER, NUMBER = "\x09-\x0d\x20\x85\xa0", "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
    #: In bytes, what a block leaves to the tokenizer: special tokens, contractions, a capital with a lower case of two parts.
    OTHER = re.compile(rb"<\||'(?:[stmd]|re|ve|ll)|\xc4\xb0", re.I)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kinds = [re.compile(f"[{x}]") for x in (self.SPACE, self.LETTER, self.NUMBER)]
        self.kind = np.array([next((k for k, r in enumerate(kinds) if r.match(chr(c))), 3) for c in range(0x250)], np.uint8)
        self.hasher = WordHasher(b"", seed=23)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.known.update(zip(hashes, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32)])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text of a block (bytes and offsets), without special tokens of its own."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        n, rows = len(data), len(offsets) - 1
        raw = data.tobytes()
        code = data.astype(np.int32)
        lead, rest = np.flatnonzero(data >= 0xC0), np.flatnonzero((data >= 0x80) & (data < 0xC0))
        code[lead] = ((code[lead] & 0x1F) << 6) | (code[np.minimum(lead + 1, n - 1)] & 0x3F)
        code[lead[data[lead] >= 0xE0]] = 0x250
        code[rest] = code[rest - 1] if len(rest) else 0
        slow = np.zeros(rows, bool)
        odd = np.concatenate([np.flatnonzero(code >= 0x250), np.fromiter((m.start() for m in self.OTHER.finditer(raw)), np.int64)])
        slow[np.searchsorted(offsets, odd, side="right") - 1] = True
        kind = self.kind[np.minimum(code, 0x24F)]
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin |= kind == 2
        begin[rest] = False
        begin[offsets[offsets < n]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        word = kind[starts] != 0 if n else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        of = np.searchsorted(offsets, starts, side="right") - 1
        fast = ~slow[of]
        starts, ends, of = starts[fast], ends[fast], of[fast]
        self.hasher._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hasher.values[data] * self.hasher.powers[:n], out=sums[1:])
        hashes, first, at = np.unique(self.hasher.range(sums, starts, ends), return_index=True, return_inverse=True)
        listed = hashes.tolist()
        new = [i for i, h in enumerate(listed) if h not in self.known]
        if new:
            self._learn([listed[i] for i in new], [raw[starts[first[i]] : ends[first[i]]].decode() for i in new])
        number = np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))[at]
        sizes = self.sizes[number]
        stops = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[number] - stops + sizes, sizes) + np.arange(stops[-1])] if len(stops) else np.zeros(0, np.uint32)
        edges = np.concatenate([[0], stops])[np.searchsorted(of, np.arange(rows + 1))]
        for row in range(rows):
            if slow[row]:
                yield np.array(self.tokenizer.encode(raw[offsets[row] : offsets[row + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[edges[row] : edges[row + 1]]


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for each Python worker: its memory of words serves all tasks that the worker runs."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = str(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            for first, data, offsets in text_blocks(batch.column(1), WORD_BLOCK):
                out = [[] for _ in range(5)]
                for row, got in enumerate(tokens.encode(data, offsets)):
                    whole = np.append(got, np.uint32(END)).astype("<u4")
                    for k, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        for column, value in zip(out, (first + row, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- bins


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces over half a bin with what cannot join them."""
    sizes = sorted(counts, reverse=True)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for least in {s for s in sizes if 2 * s <= capacity} | {0}:
        big = sum(counts[s] for s in sizes if s > capacity - least)
        middle = [(s, counts[s]) for s in sizes if capacity - least >= s and 2 * s > capacity]
        small = sum(s * counts[s] for s in sizes if 2 * s <= capacity and s >= least)
        room = sum((capacity - s) * n for s, n in middle)
        best = max(best, big + sum(n for _, n in middle) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and multiplicities of best fit decreasing: equal bins are filled together."""
    bins: dict[int, list[list]] = {}  # room -> [(contents, how many)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            rooms = [r for r in bins if r >= size]
            if rooms:
                room = min(rooms)
                contents, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                use = min(n, left)
                if n > use:
                    bins.setdefault(room, []).append([contents, n - use])
                bins.setdefault(room - size, []).append([contents + (size,), use])
                left -= use
            else:
                fit = capacity // size
                full, rest = divmod(left, fit)
                if full:
                    bins.setdefault(capacity - fit * size, []).append([(size,) * fit, full])
                if rest:
                    bins.setdefault(capacity - rest * size, []).append([(size,) * rest, 1])
                left = 0
    return [(contents, n) for group in bins.values() for contents, n in group]


class Completion:
    """Branch-and-bound over fillings around the largest piece."""

    def __init__(self, counts: dict[int, int], capacity: int, steps: int = STEPS):
        self.capacity, self.steps = capacity, steps
        self.count = np.zeros(capacity + 1, np.int64)
        for s, n in counts.items():
            self.count[s] = n
        self.volume = sum(s * n for s, n in counts.items())
        self.bound = lower_bound(counts, capacity)
        self.best = best_fit_decreasing(counts, capacity)
        self.best_bins = sum(n for _, n in self.best)
        self.path: list[tuple[tuple[int, ...], int]] = []

    def solve(self) -> list[tuple[tuple[int, ...], int]]:
        """Depth first over the fillings of the largest remaining piece's bin."""
        stack: list[Iterator] = [self.fillings()]
        used = waste = 0
        while stack and self.best_bins > self.bound and self.steps > 0:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if self.path:
                    contents, n = self.path.pop()
                    self._change(contents, n)
                    used, waste = used - n, waste - n * (self.capacity - sum(contents))
                continue
            contents, n = step
            lost = n * (self.capacity - sum(contents))
            if waste + lost > (self.best_bins - 1) * self.capacity - self.volume:
                continue  # no better packing wastes so much
            self._change(contents, -n)
            self.path.append((contents, n))
            used, waste = used + n, waste + lost
            if self.count.any():
                stack.append(self.fillings())
                continue
            if used < self.best_bins:
                self.best, self.best_bins = list(self.path), used
            self.path.pop()
            self._change(contents, n)
            used, waste = used - n, waste - lost
        if self.steps <= 0 and self.count.any():
            rest = best_fit_decreasing({int(s): int(self.count[s]) for s in np.flatnonzero(self.count)}, self.capacity)
            if used + sum(n for _, n in rest) < self.best_bins:
                self.best, self.best_bins = [*self.path, *rest], used + sum(n for _, n in rest)
        return self.best

    def _change(self, contents: tuple[int, ...], n: int) -> None:
        for s in contents:
            self.count[s] += n

    def fillings(self) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings of the bin of the largest piece, least waste first, each with falling multiplicities."""
        top = int(np.flatnonzero(self.count)[-1])
        left = np.minimum(self.count, self.capacity).astype(np.int16)  # a bin holds no more of one length
        left[top] = min(int(self.count[top]) - 1, self.capacity)
        room = self.capacity - top
        sums = reachable(np.flatnonzero(left[: room + 1]).tolist(), room)
        for waste in range(room + 1):
            if not sums[room - waste]:
                continue
            for contents in self._exactly(room - waste, room - waste, left, sums):
                if undominated(contents, waste, left):
                    need: dict[int, int] = {}
                    for s in (top, *contents):
                        need[s] = need.get(s, 0) + 1
                    # Whoever took fillings beyond this one has put them back.
                    for n in range(min(int(self.count[s]) // k for s, k in need.items()), 0, -1):
                        yield (top, *contents), n
                if self.steps <= 0:
                    return

    def _exactly(self, total: int, most: int, left: np.ndarray, sums: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Multisets of pieces that are left, none over most, with exactly this total; larger pieces first."""
        self.steps -= 1
        if self.steps <= 0:
            return
        if total == 0:
            yield ()
            return
        high = min(most, total)
        fits = (np.flatnonzero((left[1 : high + 1] > 0) & sums[total - high : total][::-1]) + 1).astype(np.int16)
        for at in range(len(fits) - 1, -1, -1):
            piece = int(fits[at])
            left[piece] -= 1
            try:
                if piece == total:
                    yield (piece,)
                else:
                    for more in self._exactly(total - piece, piece, left, sums):
                        yield (piece, *more)
            finally:
                left[piece] += 1
            if self.steps <= 0:
                return


def reachable(sizes: list[int], room: int) -> np.ndarray:
    """Which totals up to room some pieces of these sizes have, were there enough of each: no other total can be filled."""
    known, mask = 1, (1 << (room + 1)) - 1
    for s in sizes:
        step = s
        while step <= room:
            known |= (known << step) & mask
            step *= 2
    return np.unpackbits(np.frombuffer(known.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little")[: room + 1].astype(bool)


def undominated(contents: tuple[int, ...], waste: int, left: np.ndarray) -> bool:
    """False if one more piece fits, or if one or two of the pieces could give way to a larger one that is left.

    While the pieces of contents are taken out of left by the caller's enumeration, left is what remains.
    """
    if left[1 : waste + 1].any():
        return False
    for a in set(contents):
        if waste and left[a + 1 : a + waste + 1].any():
            return False
    for i, a in enumerate(contents):
        for b in set(contents[i + 1 :]):
            if left[a + b : a + b + waste + 1].any():
                return False
    return True


def solve(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes of a bin) and how many bins have each; full pieces are bins of their own."""
    full = counts.get(capacity, 0)
    rest = {s: n for s, n in counts.items() if 0 < s < capacity and n}
    out = [((capacity,), full)] if full else []
    return out + (Completion(rest, capacity, steps).solve() if rest else [])


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (size, first rank, pieces of the size in a bin, first bin, offset in a bin), sorted; ranks of a size are contiguous."""
    rows, rank, first = [], {}, 0
    for contents, n in sorted(patterns, reverse=True):
        offset = 0
        for size in sorted(set(contents), reverse=True):
            each = contents.count(size)
            rows.append((size, rank.get(size, 0), each, first, offset))
            rank[size] = rank.get(size, 0) + each * n
            offset += each * size
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = stash(pieces(docs, tokenizer, capacity=capacity), "pieces")
    several = max(CELLS, -(-rows.count() // CELL_PIECES))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(several)).cast("int"))
    cells = stash(rows.groupBy("length", "cell").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(solve(counts, capacity))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece")) - 1 + F.col("ahead")

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, at: pa.Array) -> pa.Array:
        size, at = length.to_numpy(zero_copy_only=False), at.to_numpy(zero_copy_only=False)
        key = table[:, 0] * (1 << 48) + table[:, 1]
        slot = table[np.searchsorted(key, size * (1 << 48) + at, side="right") - 1]
        bins, turn = np.divmod(at - slot[:, 1], slot[:, 2])
        return pa.StructArray.from_arrays([pa.array(slot[:, 3] + bins), pa.array(slot[:, 4] + turn * size)], ["sequence_id", "offset"])

    ranked = rows.join(ahead, ["length", "cell"]).withColumn("rank", rank)
    return ranked.withColumn("place", place(F.col("length"), F.col("rank"))).select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
