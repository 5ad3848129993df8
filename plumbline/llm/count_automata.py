"""Weighted acyclic automata of word n-grams: built from sorted n-grams, cut by prefix range, united, pruned and composed.

An automaton accepts phrases of one to DEPTH words; the weight of an arc is the count of the phrase that ends with it.  In
memory its arcs are held level by level in the order of the phrases (label, weight, arc above).  Packed, states with equal arcs
are one state.  Labels are places in a sorted table of words, so that the order of labels is the byte order of words.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import mix

DEPTH = 3


class Automaton(NamedTuple):
    words: pa.Array
    labels: list[np.ndarray]
    weights: list[np.ndarray]
    above: list[np.ndarray]  # the first is empty

    @property
    def arcs(self) -> int:
        return sum(map(len, self.labels))


def _starts(above: np.ndarray, n: int) -> np.ndarray:
    """First arc below each of n arcs, and the end."""
    return np.searchsorted(above, np.arange(n + 1))


def _grouped(keys: np.ndarray, weights: np.ndarray, join: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the joined weights of each, and the place of every key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], join.reduceat(weights[order], first) if len(first) else weights[:0], place


def sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and the place of every word among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def build(words: pa.Array, follows: np.ndarray, own: int) -> Automaton:
    """Counts of the phrases that begin at the first `own` of the words; follows[i]: word i stands behind i - 1 in its piece.

    The n-grams of each length are sorted behind their beginnings, so that a level's arcs come in the order of the phrases.
    """
    table, label = sorted_words(words)
    n = len(label)
    labels, weights, above = [], [], []
    last, at = label[:own], np.arange(own)  # the arc that each occurrence's beginning ends with; its first word
    for depth in range(DEPTH):
        if depth:
            on = at + depth < n
            on[on] = follows[at[on] + depth]
            at, last = at[on], last[on]
            keys = last << 32 | label[at + depth]
        else:
            keys = last
        found, count, last = _grouped(keys, np.ones(len(keys), np.int64), np.add)
        labels.append(found & 0xFFFFFFFF)
        weights.append(count)
        above.append(found >> 32 if depth else np.zeros(0, np.int64))
    return Automaton(table, labels, weights, above)


def assemble(words: pa.Array, phrases: list[np.ndarray], weights: list[np.ndarray], join: np.ufunc) -> Automaton:
    """The automaton of phrases given by length (rows of labels), with the joined weights of equal ones; 0 for beginnings."""
    labels, out, above = [], [], []
    place = [np.zeros(0, np.int64)] * DEPTH
    for depth in range(DEPTH):
        on = range(depth, DEPTH)
        keys = [place[k] << 32 | phrases[k][:, depth] if depth else phrases[k][:, 0] for k in on]
        values = [weights[k] if k == depth else np.zeros(len(weights[k]), np.int64) for k in on]
        found, value, at = _grouped(np.concatenate(keys), np.concatenate(values), join)
        place[depth:] = np.split(at, np.cumsum([len(x) for x in keys])[:-1])
        labels.append(found & 0xFFFFFFFF)
        out.append(value)
        above.append(found >> 32 if depth else np.zeros(0, np.int64))
    return Automaton(words, labels, out, above)


def unite(parts: list[Automaton]) -> Automaton:
    """The automaton of all phrases of the parts, weights added."""
    if len(parts) == 1:
        return parts[0]
    table, rank = sorted_words(pa.concat_arrays([p.words for p in parts]))
    edges = np.cumsum([0, *(len(p.words) for p in parts)])
    labels, weights, above = [], [], []
    place = [np.zeros(1, np.int64)] * len(parts)
    for depth in range(DEPTH):
        keys = [rank[edges[k] + p.labels[depth]] if not depth else place[k][p.above[depth]] << 32 | rank[edges[k] + p.labels[depth]] for k, p in enumerate(parts)]
        found, weight, at = _grouped(np.concatenate(keys), np.concatenate([p.weights[depth] for p in parts]), np.add)
        place = np.split(at, np.cumsum([len(x) for x in keys])[:-1])
        labels.append(found & 0xFFFFFFFF)
        weights.append(weight)
        above.append(found >> 32 if depth else np.zeros(0, np.int64))
    return Automaton(table, labels, weights, above)


def _compact(a: Automaton) -> Automaton:
    """The automaton with only the words that it uses."""
    used = np.unique(np.concatenate(a.labels))
    return Automaton(a.words.take(pa.array(used)), [np.searchsorted(used, x) for x in a.labels], a.weights, a.above)


def prune(a: Automaton, least: int) -> Automaton:
    """The arcs of weight `least` or more, and those on the way to them."""
    keep = [w >= least for w in a.weights]
    for depth in range(DEPTH - 1, 0, -1):
        keep[depth - 1][a.above[depth][keep[depth]]] = True
    places = [np.cumsum(k) - 1 for k in keep]
    above = [a.above[0]] + [places[d - 1][a.above[d][keep[d]]] for d in range(1, DEPTH)]
    return _compact(Automaton(a.words, [x[k] for x, k in zip(a.labels, keep, strict=True)], [x[k] for x, k in zip(a.weights, keep, strict=True)], above))


def _split(a: Automaton, names: list[bytes], starts: list[np.ndarray], cut: tuple[bytes, ...]) -> list[int]:
    """How many arcs of each level come before a phrase of DEPTH words; a beginning of it comes before it."""
    out, low, high, there = [], 0, len(a.labels[0]), True
    for depth in range(DEPTH):
        if there:
            rank = bisect_left(names, cut[depth])
            at = low + int(np.searchsorted(a.labels[depth][low:high], rank))
            there = rank < len(names) and names[rank] == cut[depth] and at < high and a.labels[depth][at] == rank
        out.append(at + (there and depth < DEPTH - 1))
        if depth < DEPTH - 1:
            low = int(starts[depth][at])
            high = int(starts[depth][at + 1]) if there else low
            at = low
    return out


def sections(a: Automaton, cuts: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Automaton]]:
    """(number of cuts before it, part) of the parts between the sorted cuts that hold phrases.

    A part has the beginnings of its phrases too; those that belong to an earlier part have weight 0.
    """
    names = a.words.to_pylist() if cuts else []
    starts = [_starts(a.above[d], len(a.labels[d - 1])) for d in range(1, DEPTH)]
    ends = [len(x) for x in a.labels]
    places = [[0] * DEPTH, *(_split(a, names, starts, c) for c in cuts), ends]
    for k, (low, high) in enumerate(zip(places[:-1], places[1:], strict=True)):
        if low == high:
            continue
        first = list(low)
        for depth in range(DEPTH - 1, 0, -1):
            if first[depth] < high[depth]:
                first[depth - 1] = min(first[depth - 1], int(a.above[depth][first[depth]]))
        weights = [np.concatenate([np.zeros(b - f, np.int64), a.weights[d][b:e]]) for d, (f, b, e) in enumerate(zip(first, low, high, strict=True))]
        above = [a.above[0]] + [a.above[d][first[d] : high[d]] - first[d - 1] for d in range(1, DEPTH)]
        yield k, _compact(Automaton(a.words, [x[f:e] for x, f, e in zip(a.labels, first, high, strict=True)], weights, above))


def _shared(starts: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A state for each group of arcs, equal groups having one (0: no arcs), and the groups that stand for the states from 1 on."""
    lengths = np.diff(starts)
    full = np.flatnonzero(lengths)
    if not len(full):
        return np.zeros(len(lengths), np.int64), full
    size = lengths[full]
    place = np.arange(len(columns[0])) - np.repeat(starts[full], size)
    code = mix(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for column in columns:
        code = mix(code * np.uint64(31) + column.astype(np.uint64))
    sums = mix(np.add.reduceat(code, starts[full]) + size.astype(np.uint64))
    _, first, state = np.unique(sums, return_index=True, return_inverse=True)
    like = first[state]  # equal codes are checked arc by arc
    odd = size != size[like]
    at = np.minimum(np.repeat(starts[full[like]], size) + place, len(place) - 1)
    for column in columns:
        odd |= np.bincount(np.repeat(np.arange(len(full)), size)[column != column[at]], minlength=len(full)) > 0
    alone = np.flatnonzero(odd)
    state[alone] = len(first) + np.arange(len(alone))
    out = np.zeros(len(lengths), np.int64)
    out[full] = state + 1
    return out, full[np.concatenate([first, alone])]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size - 1 of each, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def pack(a: Automaton) -> bytes:
    """The minimal automaton as bytes: states with equal arcs, weights and targets are one."""
    kept, target = [], None
    for depth in range(DEPTH - 1, 0, -1):
        columns = [a.labels[depth], a.weights[depth]] + ([target] if target is not None else [])
        starts = _starts(a.above[depth], len(a.labels[depth - 1]))
        target, groups = _shared(starts, columns)
        size = np.diff(starts)[groups]
        at = _ranges(starts[groups], size)
        kept.append([_narrow(size), *(_narrow(c[at]) for c in columns)])
    words = a.words
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :]
    body = words.buffers()[2]
    text = body.to_pybytes()[offsets[0] : offsets[-1]] if body is not None else b""
    return pickle.dumps((text, _narrow(np.diff(offsets)), [_narrow(c) for c in (a.labels[0], a.weights[0], target)], kept), protocol=5)


def unpack(blob: bytes) -> Automaton:
    """The automaton of pack()."""
    text, lengths, (label, weight, target), kept = pickle.loads(blob)
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    labels, weights, above = [label.astype(np.int64)], [weight.astype(np.int64)], [np.zeros(0, np.int64)]
    for size, *columns in reversed(kept):
        size = np.concatenate([[0], size.astype(np.int64)])  # state 0 has no arcs
        starts = np.cumsum(size) - size
        target = target.astype(np.int64)
        at = _ranges(starts[target], size[target])
        labels.append(columns[0][at].astype(np.int64))
        weights.append(columns[1][at].astype(np.int64))
        above.append(np.repeat(np.arange(len(target)), size[target]))
        target = columns[2][at] if len(columns) > 2 else None
    return Automaton(words, labels, weights, above)


def compose(asked: Automaton, counts: Automaton) -> list[np.ndarray]:
    """For each level the arc of counts that ends the same phrase as each arc of asked, or -1."""
    name = pc.index_in(asked.words, value_set=counts.words).fill_null(-1).to_numpy().astype(np.int64) if len(asked.words) else np.zeros(0, np.int64)
    out: list[np.ndarray] = []
    for depth in range(DEPTH):
        label = name[asked.labels[depth]]
        known = label >= 0
        if depth:
            up = out[-1][asked.above[depth]]
            known &= up >= 0
            keys, wanted = counts.above[depth] << 32 | counts.labels[depth], np.where(known, up << 32 | label, -1)
        else:
            keys, wanted = counts.labels[0], np.where(known, label, -1)
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        out.append(np.where(known & (keys[at] == wanted), at, -1) if len(keys) else np.full(len(wanted), -1))
    return out


def phrase_labels(a: Automaton, depth: int, arcs: np.ndarray) -> np.ndarray:
    """Rows of labels of the phrases that end with the arcs of a level."""
    columns = []
    for d in range(depth, -1, -1):
        columns.append(a.labels[d][arcs])
        arcs = a.above[d][arcs] if d else arcs
    return np.column_stack(columns[::-1])


class Union:
    """A running union that is worked out whenever what waits exceeds what is there (or LEAST arcs)."""

    LEAST = 400_000

    def __init__(self, join: Callable[[list[Automaton]], Automaton] = unite):
        self.join, self.whole, self.waiting, self.arcs = join, None, [], 0

    def add(self, part: Automaton) -> None:
        self.waiting.append(part)
        self.arcs += part.arcs
        if self.arcs > max(self.LEAST, self.whole.arcs if self.whole else 0):
            self.result()

    @property
    def size(self) -> int:
        """Arcs held, equal ones of parts that wait counted more than once."""
        return self.arcs + (self.whole.arcs if self.whole else 0)

    def result(self) -> Automaton:
        parts = ([self.whole] if self.whole else []) + self.waiting
        self.whole = self.join(parts) if parts else empty()
        self.waiting, self.arcs = [], 0
        return self.whole


def empty() -> Automaton:
    none = np.zeros(0, np.int64)
    return Automaton(pa.array([], pa.binary()), [none] * DEPTH, [none] * DEPTH, [none] * DEPTH)
