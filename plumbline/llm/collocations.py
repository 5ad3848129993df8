"""Phrase collocations: exact counts of all phrases of one to three words by weighted acyclic automata.

Every task builds automata of the sorted n-grams of its blocks of text and cuts them at the bounds of prefix ranges.  A range's
parts meet in one task, which unites them, adds their weights and drops phrases that are too rare to be candidates or parts of
candidates.  Parts of candidates that belong to other ranges are looked up by composition: a range sends the automaton of its
questions to the owners, which answer with weights; a question about two words carries the count of the longer candidate
that holds them, so that the owner learns by which its phrase is contained.

The bounds of the ranges come from a sample of phrases of whole three words; they only lay out the work.  A phrase counts once
for each block and range, so a frequent one is no hot key.  Texts longer than a block are cut between pieces, or between words
with the two following words as context; memory follows blocks and ranges.

Nulls: no text, and the language `und`.  Empty tables give no rows, repeated rows count each time, further columns are not
looked at.  Equal scores go by count and then by phrase in byte order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stash
from plumbline.llm.count_automata import DEPTH, Automaton, Union, assemble, build, compose, empty, pack, phrase_labels, prune, sections, unpack

LEAST_COUNT, CONTAINED_PERCENT, SCALE, MOST = 10, 50, 1_000_000, 2000
#: Bytes of text of one automaton, and of text for each prefix range.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
#: Ranges into which a task cuts its automata at a time, and arcs that it unites before it cuts them again.
FAN, REGROUPED_ARCS = 256, 1_500_000
#: Arcs (about) of a range in which parts of candidates are looked up; frequent phrases are few.
LOOKUP_ARCS = 50_000
#: Phrases (about) that are sampled to place the bounds of the ranges, for each range.
SAMPLED = 200
BUCKETS = 64

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATOR = BREAK.copy()
SEPARATOR[list(b" \t")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(data: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, end of own bytes): phrases count where they begin in own bytes; the rest is context."""
    at = 0
    while len(data) - at > size:
        window, end = data[at : at + size], size
        ends = np.flatnonzero(BREAK[window])
        context = 0
        if len(ends):
            end = int(ends[-1]) + 1
        else:
            ends = np.flatnonzero(SEPARATOR[window])
            while not len(ends) and at + end < len(data):  # one word longer than a block
                ends = np.flatnonzero(SEPARATOR[data[at : at + 2 * end]])
                end *= 2
            end = int(ends[-1]) + 1 if len(ends) else len(data) - at
            reach = 4096
            while True:  # the next two words
                piece = data[at + end : at + end + reach]
                stop = np.flatnonzero(np.diff(SEPARATOR[piece].astype(np.int8)) > 0)
                if len(stop) >= DEPTH - 1 or len(piece) < reach:
                    context = int(stop[DEPTH - 2]) + 1 if len(stop) >= DEPTH - 1 else len(piece)
                    break
                reach *= 2
        yield data[at : at + end + context], end
        at += end
    if at < len(data):
        yield data[at:], len(data) - at


def count_block(data: np.ndarray, own: int) -> Automaton:
    """Counts of the phrases of a block."""
    data = LOWER[data]
    inside = ~SEPARATOR[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    piece = np.cumsum(BREAK[data])[starts]
    follows = np.zeros(len(starts), bool)
    follows[1:] = piece[1:] == piece[:-1]
    return build(words, follows, int(np.searchsorted(starts, own)))


class Ranges:
    """Numbers of prefix ranges: bounds are (language, three words), and a bound begins a range."""

    def __init__(self, bounds: list[tuple]):
        self.bounds = sorted(set(bounds))

    def coarser(self, times: int) -> Ranges:
        """Ranges that hold so many of these each: range k lies in k // times."""
        return Ranges(self.bounds[times - 1 :: times])

    def sections(self, lang: str, a: Automaton) -> Iterator[tuple[int, Automaton]]:
        low = bisect_left(self.bounds, (lang,))
        high = bisect_left(self.bounds, (lang + "\0",))
        for k, part in sections(a, [b[1:] for b in self.bounds[low:high]]):
            yield low + k, part


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(language, its texts joined by line feeds) of a batch."""
    langs = batch.column(0).dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = batch.column(1).filter(pc.equal(langs.indices, k))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.cast(pa.string())), "\n")
        body = joined[0].as_buffer()
        yield lang, np.frombuffer(body, np.uint8) if body.size else np.zeros(0, np.uint8)


def find_ranges(texts: DataFrame) -> Ranges:
    """Bounds of ranges of about RANGE_BYTES of text each, from a sample of phrases."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = -(-size // RANGE_BYTES)
    if ranges < 2:
        return Ranges([])
    every = max(512, size // (SAMPLED * ranges))  # bytes of text for a sampled phrase, if all texts were read
    share = min(1.0, 4096 / every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        for batch in batches:
            out = []
            for lang, data in _by_lang(batch):
                for at in np.flatnonzero(rng.random(len(data) // 512 + 1) < 512 / every / share):
                    words = bytes(LOWER[data[at * 512 : at * 512 + 512]]).translate(None, b".,;:!?").split()[1:]
                    words = (words + [b"", b"", b""])[:DEPTH] if words else [b""] * DEPTH
                    out.append((lang, *words))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, DEPTH + 1))], ["lang", "a", "b", "c"])

    found = (texts.sample(share, seed=11) if share < 1 else texts).mapInArrow(run, "lang string, a binary, b binary, c binary")
    phrases = sorted(map(tuple, zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True)))  # SAMPLED for each range
    step = max(1, len(phrases) / ranges)
    return Ranges([phrases[int(k * step)] for k in range(1, int(ranges)) if int(k * step) < len(phrases)])


#: sender: the range that asks or answers; of counts, the number of arcs.
PARTS = "lang string, range int, kind int, sender int, words long, blob binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["lang", "range", "kind", "sender", "words", "blob"])


COUNTS, ASKED, ANSWERED, WITHIN = range(4)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, int, bytes, bool]]:
    """Rows of PARTS one by one, with whether the row begins another range of a language."""
    last = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = [batch.column(c)[k].as_py() for c in range(6)]
            yield (*row, (row[0], row[1]) != last)
            last = row[0], row[1]


def _counts(ranges: Ranges, lang: str, a: Automaton) -> Iterator[pa.RecordBatch]:
    rows = [(lang, k, COUNTS, part.arcs, int(part.weights[0].sum()), pack(part)) for k, part in ranges.sections(lang, a)]
    if rows:
        yield _batch(rows)


def count_parts(texts: DataFrame, ranges: Ranges) -> DataFrame:
    """PARTS of kind COUNTS: the automata of all blocks, cut at the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            line = np.array([10], np.uint8)
            data = np.concatenate([x for part in held.pop(lang) for x in (part, line)])
            sizes.pop(lang)
            for block, own in blocks(data):
                counted = count_block(block, own)
                del block
                yield from _counts(ranges, lang, counted)
                del counted
                pa.default_memory_pool().release_unused()

        for batch in batches:
            for lang, data in _by_lang(batch):
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= BLOCK_BYTES:
                    yield from flush(lang)
            if sum(sizes.values()) >= 2 * BLOCK_BYTES:
                for lang in list(held):
                    yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    return texts.mapInArrow(run, PARTS)


def _meet(parts: DataFrame) -> DataFrame:
    return parts.repartition("lang", "range").sortWithinPartitions("lang", "range", "kind")


def regroup(parts: DataFrame, ranges: Ranges) -> DataFrame:
    """The parts of wider ranges, united as far as memory goes and cut at the bounds of narrower ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, last = Union(), None
        for lang, _, _, _, _, blob, new in _groups(batches):
            if last is not None and (new or union.size >= REGROUPED_ARCS):
                yield from _counts(ranges, last, union.result())
                union = Union()
            union.add(unpack(blob))
            last = lang
        if last is not None:
            yield from _counts(ranges, last, union.result())

    return _meet(parts).mapInArrow(run, PARTS)


def unite_parts(parts: DataFrame) -> DataFrame:
    """One automaton for each language and range, with its arcs and the words counted there; rare phrases are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, words, key = Union(), 0, None

        def close() -> pa.RecordBatch:
            a = prune(union.result(), LEAST_COUNT)
            return _batch([(*key, COUNTS, a.arcs, words, pack(a))])

        for lang, number, _, _, more, blob, new in _groups(batches):
            if new and key:
                yield close()
            if new:
                union, words, key = Union(), 0, (lang, number)
                pa.default_memory_pool().release_unused()
            words += more
            union.add(unpack(blob))
        if key:
            yield close()

    return _meet(parts).mapInArrow(run, PARTS)


def count_phrases(texts: DataFrame) -> tuple[DataFrame, Ranges]:
    """The automata of all frequent phrases, one for each language and lookup range, and these ranges.

    A task cuts what it has into FAN ranges or so; where more are needed, parts go through wider ranges first, so that the
    number of parts grows with the text, not with its square.
    """
    ranges = find_ranges(texts)
    levels = [1]
    while len(ranges.bounds) // levels[-1] > FAN:
        levels.append(levels[-1] * FAN)
    parts = count_parts(texts, ranges.coarser(levels[-1]))
    for times in levels[-2::-1]:
        parts = regroup(parts, ranges.coarser(times))
    counted = stash(unite_parts(parts), "collocation-counts")
    arcs = counted.agg(F.sum("sender")).first()[0] or 0
    wider = max(1, (len(ranges.bounds) + 1) * LOOKUP_ARCS // max(arcs, 1))
    wider = min(wider, len(ranges.bounds) + 1)
    if wider > 1:
        counted = stash(unite_parts(counted.withColumn("range", F.floor(F.col("range") / wider).cast("int"))), "collocation-lookups")
    return counted, ranges.coarser(wider)


def candidates(counts: Automaton) -> list[np.ndarray]:
    """Arcs of each level that end candidates (none for single words)."""
    return [np.zeros(0, np.int64)] + [np.flatnonzero(w >= LEAST_COUNT) for w in counts.weights[1:]]


def ask(counted: DataFrame, ranges: Ranges) -> DataFrame:
    """PARTS of kind ASKED: the parts of each range's candidates, to the ranges that count them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, _, _, _, blob, _ in _groups(batches):
            a = unpack(blob)
            found = candidates(a)
            two, three = (phrase_labels(a, d, found[d]) for d in (1, 2))
            single = np.concatenate([two[:, 0], two[:, 1], three[:, 0], three[:, 2]])[:, None]
            pairs = np.concatenate([three[:, :2], three[:, 1:]])
            longer = a.weights[2][found[2]]
            asked = assemble(a.words, [single, pairs, np.zeros((0, DEPTH), np.int64)], [np.zeros(len(single), np.int64), np.concatenate([longer, longer]), np.zeros(0, np.int64)], np.maximum)
            rows = [(lang, k, ASKED, number, 0, pack(part)) for k, part in ranges.sections(lang, asked)]
            if rows:
                yield _batch(rows)

    return counted.mapInArrow(run, PARTS)


def answer(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """PARTS of kind ANSWERED, to those who asked, and WITHIN, the count of the longest holder of each pair, to the owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, within, key = empty(), None, None

        def close() -> pa.RecordBatch:
            return _batch([(*key, WITHIN, key[1], 0, within.tobytes())])

        for lang, number, kind, sender, _, blob, new in _groups(batches):
            if new and key:
                yield close()
            if new:
                a, within, key = empty(), np.zeros(0, np.int64), (lang, number)
            if kind == COUNTS:
                a = unpack(blob)
                within = np.zeros(len(a.labels[1]), np.int64)
                continue
            question = unpack(blob)
            at = compose(question, a)
            weights = [np.where(k >= 0, w[k], 0) if len(w) else np.zeros(len(k), np.int64) for k, w in zip(at, a.weights, strict=True)]
            known = at[1] >= 0
            np.maximum.at(within, at[1][known], question.weights[1][known])
            yield _batch([(lang, sender, ANSWERED, number, 0, pack(question._replace(weights=weights)))])
        if key:
            yield close()

    return _meet(counted.unionByName(asked)).mapInArrow(run, PARTS)


def _scored(a: Automaton, within: np.ndarray, parts: Automaton) -> list[tuple]:
    """(phrase, a, l, r, score) of the range's candidates that no longer one contains, best MOST."""
    out = []
    found = candidates(a)
    for depth in (1, 2):
        arcs = found[depth]
        if depth == 1:
            arcs = arcs[100 * within[arcs] < CONTAINED_PERCENT * a.weights[1][arcs]]
        if not len(arcs):
            continue
        rows, count = phrase_labels(a, depth, arcs), a.weights[depth][arcs]
        best = None
        for k in range(1, depth + 1):
            sides = []
            for piece in (rows[:, :k], rows[:, k:]):
                width = piece.shape[1]
                asked = assemble(a.words, [piece if width == d + 1 else np.zeros((0, d + 1), np.int64) for d in range(DEPTH)], [np.zeros(len(piece) if width == d + 1 else 0, np.int64) for d in range(DEPTH)], np.maximum)
                arc = asked.labels[0].searchsorted(piece[:, 0])
                if width > 1:
                    arc = np.searchsorted(asked.above[1] << 32 | asked.labels[1], arc << 32 | piece[:, 1])
                sides.append(parts.weights[width - 1][compose(asked, parts)[width - 1][arc]])
            big = count.astype(object)
            score = (SCALE * big * big // (sides[0].astype(object) * sides[1].astype(object))).astype(np.int64)  # exact: Python integers
            if best is None:
                best = [score, *sides]
            else:
                less = score < best[0]
                best = [np.where(less, x, y) for x, y in zip([score, *sides], best, strict=True)]
        names = a.words.to_pylist()
        out += [(b" ".join(names[x] for x in row), int(n), int(left), int(right), int(s)) for row, n, s, left, right in zip(rows.tolist(), count, *best, strict=True)]
    return sorted(out, key=lambda x: (-x[4], -x[1], x[0]))[:MOST]


def score_candidates(counted: DataFrame, answers: DataFrame) -> DataFrame:
    """lang, range, phrase, a, l, r, score of each range's best candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, within, union, key = empty(), np.zeros(0, np.int64), Union(), None

        def close() -> pa.RecordBatch:
            rows = _scored(a, within, union.result())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.string()), pa.array([key[1]] * len(rows), pa.int32()), pa.array([p.decode() for p in columns[0]], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["lang", "range", "phrase", "a", "l", "r", "score"])

        for lang, number, kind, _, _, blob, new in _groups(batches):
            if new and key:
                yield close()
            if new:
                a, within, union, key = empty(), np.zeros(0, np.int64), Union(), (lang, number)
            if kind == COUNTS:
                a = unpack(blob)
            elif kind == ANSWERED:
                union.add(unpack(blob))
            else:
                within = np.frombuffer(blob, np.int64) if blob else np.zeros(0, np.int64)
        if key:
            yield close()

    return _meet(counted.unionByName(answers)).mapInArrow(run, "lang string, range int, phrase string, a long, l long, r long, score long")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's MOST best phrases of two and three words."""
    counted, ranges = count_phrases(_texts(docs, text_col, lang_col))
    found = score_candidates(counted, answer(counted, ask(counted, ranges)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = Window.partitionBy("lang", "bucket").orderBy(*order)
    first = found.withColumn("bucket", F.pmod(F.hash("phrase"), F.lit(BUCKETS))).withColumn("k", F.row_number().over(few)).where(F.col("k") <= MOST)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= MOST)  # of BUCKETS * MOST rows at most
    words = counted.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, on whole tables.
REPORT_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    starts AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
    f AS (
        SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
        FROM starts, (VALUES (1), (2), (3)) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
    ),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
    cuts AS (
        SELECT c.lang, c.k, c.phrase, c.a, j, l.f AS l, r.f AS r, 1000000 * c.a * c.a // (l.f * r.f) AS score
        FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1:j], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[j + 1:], ' ')
    ),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    holders AS (
        SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, array_to_string(s[1:2], ' ') AS phrase, a FROM c WHERE k = 3
            UNION ALL SELECT lang, array_to_string(s[2:3], ' ') AS phrase, a FROM c WHERE k = 3
        ) GROUP BY ALL
    ),
    ranked AS (
        SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank
        FROM best LEFT JOIN holders h ON h.lang = best.lang AND h.phrase = best.phrase AND best.k = 2
        WHERE h.a IS NULL OR 100 * h.a < 50 * best.a
    ),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang)
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
