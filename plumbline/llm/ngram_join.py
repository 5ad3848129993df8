"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles (hashes of 56 bits); documents with equal sets are one class.  The
tokens of a set stand in one global order: by frequency class in a counting sketch of fixed size over all documents, rare
first, then by hash.  If two sets of Jaccard similarity t or more are cut to prefixes of size - ceil(t * size) + l, they
share at least l tokens in them.  Each document picks its own l: a longer prefix costs more index rows, but only partners
that share l of its tokens remain, at most the sum of their frequencies over l.  A pair counts by the smaller l.

Pairs that share enough are cut by size and by what positions still allow, then verified on whole sets.  Verification is
in phases: first each document's best partners, then only pairs whose documents are not connected yet, because a pair
inside a component changes nothing.  Posting lists longer than LONG_LIST (large groups of near copies) are not paired off:
their members meet the list's first members, and then only members outside the component that most of the list belongs to
meet the others.  So every link between different components is found, and none inside is needed: the result is exact
whatever LONG_LIST, HEADS and BEST are, and links within a component are not counted.

A document without words is linked with nothing; one of fewer than five words is its whole sequence.  Rows with equal ids
and texts are equal rows; null ids are kept and never name a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import SPACES, WordHasher, mix, stash, text_blocks
from plumbline.llm.components import connected_components

WORDS, PERCENT = 5, 80
#: Counters of the sketch (a power of two) and the rows that it is sent in.
SKETCH, SKETCH_ROWS = 1 << 22, 256
MOST_MATCHES = 4
LONG_LIST, HEADS = 32, 8
#: Partners of each document that are verified first.
BEST = 3
#: Bits of the filter that keeps whole sets of documents without candidates from being shuffled.
FILTER_BITS = 1 << 24
LOW = np.uint64((1 << 56) - 1)
_HASHER = WordHasher(SPACES, lower=True, seed=5)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (56 bits) of all shingles of a block of texts, and their rows, ascending."""
    starts, ends, rows, sums = _HASHER.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = _HASHER.range(sums, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[rows]
    take = np.where(count[rows] >= WORDS, place <= count[rows] - WORDS, place == 0)
    at = np.flatnonzero(take)
    total = np.zeros(len(at), np.uint64)
    short = np.minimum(count[rows[at]], WORDS)
    for k in range(WORDS):
        part = words[np.minimum(at + k, len(words) - 1)] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
        total += np.where(k < short, part, np.uint64(0))
    return mix(total + short.astype(np.uint64)) & LOW, rows[at]


def distinct_sorted(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, sorted within rows, and offsets (n + 1)."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[new], rows[new]
    return keys, np.searchsorted(rows, np.arange(n + 1))


def set_names(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set of hashes, 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys & LOW), dtype=np.uint64)])
    size = np.diff(offsets)
    names = mix((sums[offsets[1:]] - sums[offsets[:-1]]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    return np.where(size > 0, np.maximum(names, 1), 0).astype(np.int64)


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """first row, distinct shingle hashes, offsets, names, by blocks of texts."""
    for first, data, offsets in text_blocks(texts):
        n = len(offsets) - 1
        keys, at = distinct_sorted(*shingles(data, offsets), n)
        yield first, keys, at, set_names(keys, at)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over all texts: a row (id, n, name) for each document, and rows (part, counts) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        seen = False
        for batch in batches:
            sizes, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, keys, at, name in _sets(batch.column(1)):
                seen = True
                sizes[first : first + len(name)], names[first : first + len(name)] = np.diff(at), name
                np.add.at(counts, (keys >> np.uint64(56 - SKETCH.bit_length() + 1)).astype(np.int64), np.uint32(1))
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(names), none.cast(pa.int32()), none.cast(pa.binary())], _SCAN)
        if seen:
            from zlib import compress

            for part, piece in enumerate(np.split(counts, SKETCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([part], pa.int32()), pa.array([compress(piece.tobytes(), 1)], pa.binary())], _SCAN)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, name long, part int, counts binary")


_SCAN = ["id", "n", "name", "part", "counts"]


def frequency_classes(sketch: DataFrame) -> np.ndarray:
    """The class (about twice the binary logarithm of the count) of each counter: SKETCH bytes, however large the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import decompress

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece = np.frombuffer(decompress(counts), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + piece if part in sums else piece
        for part, total in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "classes": [np.minimum(2 * np.log2(total + 1.0), 200).astype(np.uint8).tobytes()]})

    classes = np.zeros(SKETCH, np.uint8)
    size = SKETCH // SKETCH_ROWS
    for row in sketch.repartition("part").mapInArrow(add, "part int, classes binary").collect():
        classes[row.part * size : (row.part + 1) * size] = np.frombuffer(row.classes, np.uint8)
    return classes


def ordered(keys: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens (class in the top byte, then the hash) sorted within rows: the global order."""
    tokens = (classes[(keys >> np.uint64(56 - SKETCH.bit_length() + 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | keys
    return distinct_sorted(tokens, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), len(offsets) - 1)[0]


def prefix_rows(tokens: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """row, token, position, level and the row's matches l, of the tokens in each row's chosen prefix.

    The level is the least l whose prefix holds the position.  l minimises prefix rows plus expected candidates, where a
    token's expected list is what its frequency class says.
    """
    size = np.diff(offsets)
    base = size - -(-percent * size // 100) + 1
    base = np.where(size > 0, base, 0)
    cost = np.exp2((tokens >> np.uint64(56)).astype(float) / 2)
    sums = np.concatenate([[0.0], np.cumsum(cost)])
    best, choice = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for level in range(1, MOST_MATCHES + 1):
        length = base + level - 1
        total = length + (sums[np.minimum(offsets[:-1] + length, offsets[1:])] - sums[offsets[:-1]]) / level
        better = (length <= size) & (total < best)
        best, choice = np.where(better, total, best), np.where(better, level, choice)
    length = np.where(size > 0, base + choice - 1, 0)
    row = np.repeat(np.arange(len(size)), length)
    position = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return row, tokens[offsets[row] + position], position, np.maximum(1, position - base[row] + 2), choice[row]


def postings(docs: DataFrame, classes, text_col: str = "text") -> DataFrame:
    """token, name, n, position, level, matches, for every distinct set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = classes.value, set()
        for batch in batches:
            for _, keys, at, names in _sets(batch.column(0)):
                fresh = np.zeros(len(names), bool)
                for i, name in enumerate(names.tolist()):  # copies within a task go no further
                    if name and name not in seen:
                        fresh[i] = True
                        seen.add(name)
                if len(seen) > 1_000_000:
                    seen.clear()
                row, token, position, level, matches = prefix_rows(ordered(keys, at, table), at)
                keep = fresh[row]
                row = row[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[keep].astype(np.int64)), pa.array(names[row]), pa.array(np.diff(at)[row].astype(np.int32)), pa.array(position[keep].astype(np.int32)), pa.array(level[keep].astype(np.int8)), pa.array(matches[keep].astype(np.int8))],
                    ["token", "name", "n", "position", "level", "matches"],
                )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token long, name long, n int, position int, level byte, matches byte")


def needed(na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection for the similarity: i * 100 >= percent * (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def _pair_up(token, name, n, position, level, matches, a, b) -> pa.RecordBatch:
    """Rows for pairs (indexes a, b) of one list whose sizes and levels allow a link, both prefixes cut for the pair."""
    swap = name[a] > name[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    least = needed(n[a], n[b])
    both = np.minimum(matches[a], matches[b])
    own = lambda x: position[x] <= n[x] - least + both - 1
    good = (least <= np.minimum(n[a], n[b])) & (level[a] <= both) & (level[b] <= both) & own(a) & own(b)
    a, b = a[good], b[good]
    return pa.RecordBatch.from_arrays(
        [pa.array(name[a]), pa.array(name[b]), pa.array(n[a]), pa.array(n[b]), pa.array(position[a]), pa.array(position[b]), pa.array(both[good].astype(np.int8)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int8()), pa.nulls(len(a), pa.int8())], _PAIRS
    )


_PAIRS = ["a", "b", "na", "nb", "pa", "pb", "matches", "token", "level", "own"]
_PAIRS_SCHEMA = "a long, b long, na int, nb int, pa int, pb int, matches byte, token long, level byte, own byte"


def meet(rows: DataFrame) -> DataFrame:
    """Streams posting lists (sorted by token, position and name) into pairs, and into rows of long lists.

    Short lists give all their pairs.  A long list gives each member with the list's first HEADS, as pairs with own = 0, and
    each member as a row of the list (a = name, token set).  The first ones have the fewest rarer tokens, so of a group of
    near copies they are those nearest to what all have in common.  Memory holds one batch and at most LONG_LIST rows.
    """

    def long_rows(c: list[np.ndarray], heads: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        token, name, n, position, level, matches = c
        k = len(token)
        if not k:
            return
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.nulls(k, pa.int64()), pa.array(n), pa.nulls(k, pa.int32()), pa.array(position), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int8()), pa.array(token), pa.array(level), pa.array(matches)], _PAIRS)
        for head, size in heads:
            can = (name != head) & (needed(n, np.int32(size)) <= np.minimum(n, size))
            own, m = name[can], n[can]
            k, less = len(own), own < head
            if k:
                x, y, nx, ny = np.where(less, own, head), np.where(less, head, own), np.where(less, m, size).astype(np.int32), np.where(less, size, m).astype(np.int32)
                zero = pa.array(np.zeros(k, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(nx), pa.array(ny), zero, zero, pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int8()), pa.array(np.zeros(k, np.int8))], _PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of a short list that may go on in the next batch
        opened: list | None = None  # token, heads (name, n) and last name of a long list that may go on
        for batch in chain(batches, [None]):
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns] if batch is not None else None
            if held is not None:
                c = [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)] if c else held
                held = None
            if c is None or not len(c[0]):
                continue
            new = np.ones(len(c[0]), bool)  # equal rows of a set from several tasks are neighbours
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            c = [x[new] for x in c]
            if opened is not None:
                other = np.flatnonzero(c[0] != opened[0])
                k = int(other[0]) if len(other) else len(c[0])
                skip = int(k > 0 and c[1][0] == opened[2])
                yield from long_rows([x[skip:k] for x in c], opened[1])
                if k == len(c[0]):
                    opened[2] = c[1][-1]
                    continue
                opened, c = None, [x[k:] for x in c]
            starts = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1]]))
            sizes = np.diff(np.append(starts, len(c[0])))
            if batch is not None and sizes[-1] <= LONG_LIST:
                held = [x[starts[-1] :].copy() for x in c]
                starts, sizes = starts[:-1], sizes[:-1]
            for k in range(2, LONG_LIST + 1):
                at = starts[sizes == k]
                if len(at):
                    i, j = np.triu_indices(k, 1)
                    yield _pair_up(*c, (at[:, None] + i).ravel(), (at[:, None] + j).ravel())
            for s in starts[sizes > LONG_LIST].tolist():
                k = int(sizes[np.searchsorted(starts, s)])
                heads = [(c[1][i], int(c[2][i])) for i in range(s, s + min(k, HEADS))]
                yield from long_rows([x[s : s + k] for x in c], heads)
                if batch is not None and s + k == len(c[0]):
                    opened = [c[0][s], heads, c[1][-1]]

    sort = rows.repartition("token").sortWithinPartitions("token", "position", "name")
    return sort.mapInArrow(run, _PAIRS_SCHEMA)


def pair_counts(met: DataFrame) -> DataFrame:
    """a, b, na, nb, shared of every pair that met, fits (whether it shares enough), and the rows of long lists (b null)."""
    grouped = met.groupBy("a", "b", "token").agg(F.count("*").alias("shared"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("matches").alias("matches"), F.max("level").alias("level"), F.max("own").alias("own"), F.count("own").alias("stars"))
    least = F.ceil(PERCENT * (F.col("na") + F.col("nb")) / (100 + PERCENT))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    real = F.col("shared") - F.col("stars")
    fits = (F.col("stars") > 0) | (F.col("shared") >= F.col("matches")) & (real + rest >= least)
    return grouped.select("a", "b", "na", "nb", "shared", "pa", "token", "level", fits.alias("fits"))


def keep_bits(names: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits over names, built in the JVM; its size does not follow the corpus."""
    slot = F.pmod(F.col("name"), F.lit(FILTER_BITS)) + 1  # Spark numbers bits from 1
    parts = names.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for row in parts:
        piece = np.frombuffer(bytes(row.bits), np.uint8)
        bits[(row.bucket - 1) * 4096 : (row.bucket - 1) * 4096 + len(piece)] = piece
    return bits


def whole_sets(docs: DataFrame, bits, text_col: str = "text") -> DataFrame:
    """name, keys (sorted) of the sets that the filter keeps, one for each task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = bits.value, set()
        for batch in batches:
            for _, keys, at, names in _sets(batch.column(0)):
                slot = names % FILTER_BITS
                good = (names != 0) & ((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                pick = [i for i in np.flatnonzero(good).tolist() if names[i] not in seen and not seen.add(names[i])]
                if len(seen) > 1_000_000:
                    seen.clear()
                if pick:
                    sizes = np.diff(at)[pick]
                    flat = np.concatenate([keys[at[i] : at[i + 1]] for i in pick]).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(names[pick]), lists], ["name", "keys"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "name long, keys array<long>").dropDuplicates(["name"])


@F.arrow_udf(LongType())
def _shared(x: pa.Array, y: pa.Array) -> pa.Array:
    out = []
    xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
    xv, yv = x.values.to_numpy(), y.values.to_numpy()
    for i in range(len(x)):
        p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
        at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
        out.append(int((q[at] == p).sum()) if len(q) else 0)
    return pa.array(out, pa.int64())


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the pairs whose whole sets are similar enough."""
    x, y = sets.select(F.col("name").alias("a"), F.col("keys").alias("x")), sets.select(F.col("name").alias("b"), F.col("keys").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b")
    same = both.select("a", "b", _shared("x", "y").alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return same.where(F.col("i") * 100 >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, name (of the set) of every document."""
    spark = docs.sparkSession
    scanned = stash(scan(docs, id_col, text_col), "ngram-scan")
    rows = scanned.where("part is null").select("id", "n", "name")
    classes = spark.sparkContext.broadcast(frequency_classes(scanned.where("part is not null").select("part", "counts")))
    met = stash(pair_counts(meet(postings(docs, classes, text_col))), "ngram-pairs")
    pairs, lists = met.where("b is not null"), met.where("b is null").select(F.col("a").alias("name"), "na", "pa", "level", "token")
    # A pair whose sets both stand in long lists may share more tokens there than were counted: it stays a candidate.
    long_names = stash(lists.select("name").distinct(), "ngram-long")
    mixed = pairs.where("not fits")
    for side in "ab":
        mixed = mixed.join(long_names.withColumnRenamed("name", side), side, "left_semi")
    short = stash(pairs.where("fits").unionByName(mixed.select(pairs.columns)).select("a", "b", "na", "nb", "shared"), "ngram-candidates")
    names = short.select(F.col("a").alias("name")).union(short.select("b")).union(lists.select("name")).distinct()
    bits = spark.sparkContext.broadcast(keep_bits(names))
    sets = stash(whole_sets(docs, bits, text_col), "ngram-sets")

    # Phase one: the partners with which each set shares most.
    ends = short.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("of"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("shared"), F.xxhash64("a", "b", "of")))
    first = stash(ends.withColumn("k", rank).where(F.col("k") <= BEST).select("a", "b").distinct(), "ngram-first")
    parts = stash(connected_components(stash(verify(first, sets), "ngram-links")), "ngram-parts")

    def part_of(df: DataFrame, column: str, to: str) -> DataFrame:
        return df.join(parts.select(F.col("node").alias(column), F.col("component").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))

    def merge(parts: DataFrame, links: DataFrame) -> DataFrame:
        return stash(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "ngram-parts")

    # Phase two: the other pairs that are not connected yet; then what long lists still hold in different components.
    rest = part_of(part_of(short, "a", "ca"), "b", "cb").where("ca != cb").join(first, ["a", "b"], "left_anti").select("a", "b")
    parts = merge(parts, stash(verify(rest, sets), "ngram-links"))
    crossing = cross_pairs(part_of(lists.withColumnRenamed("na", "n"), "name", "c")).join(short, ["a", "b"], "left_anti")
    final = merge(parts, stash(verify(crossing, sets), "ngram-links"))

    classes_of = rows.where("name != 0").groupBy("name").agg(F.min("id").alias("least"))
    labelled = classes_of.join(final.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stash(labelled.join(least, "component").select("name", "component_id"), "ngram-answer")
    return rows.join(answer, "name", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "name")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates that of the smallest id.

    Rows with equal ids and texts are one document; rows with equal ids and other texts stay or go together.
    """
    named = stash(ngram_components(docs, id_col, text_col).select("doc_id", "component_id", "name"), "ngram-decisions")
    gone = named.where("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
    again = named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return left
    repeated = left.join(again, left[id_col] == F.col("__again"), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, left[id_col] == F.col("__again"), "left_anti").unionByName(repeated)


#: Members of a long list that a task compares with others, about; sizes of one class are within a ratio of 100 / PERCENT.
SALT_ROWS = 4096


def size_class(n: F.Column) -> F.Column:
    """Class of a set's size: sets that are similar enough are of one class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")


def cross_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of a long list's members in different components (token, name, n, pa, level, c), each a, b.

    Members of a list's largest component do not meet each other: the others meet all members of a size that fits, in
    parts of about SALT_ROWS, so that a token of very many documents is many keys.  A pair meets at its first common
    token, which stands in both prefixes of one match; what it shares beyond that need not be counted.
    """
    lists = lists.where("level = 1").withColumn("size", size_class(F.col("n")))
    count = lists.groupBy("token", "c").agg(F.count("*").alias("k"))
    top = count.groupBy("token").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("all")).where("parts > 1")
    top = top.select("token", F.col("top.c").alias("top"), F.ceil(F.col("all") / SALT_ROWS).cast("int").alias("salts"))
    few = lists.join(top, "token").where("c != top").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).withColumn("size", F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))))
    some = lists.join(top, "token").withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int"))
    x, y = (d.select("token", "salt", "size", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "pa", "c"))) for d, s in ((few, "x"), (some, "y")))
    least = F.ceil(PERCENT * (F.col("n_x") + F.col("n_y")) / (100 + PERCENT))
    fits = (F.col("pa_x") <= F.col("n_x") - least) & (F.col("pa_y") <= F.col("n_y") - least)
    pairs = x.join(y, ["token", "salt", "size"]).where((F.col("c_x") != F.col("c_y")) & fits)
    return pairs.select(F.least("name_x", "name_y").alias("a"), F.greatest("name_x", "name_y").alias("b")).distinct()
