"""Secret scan by one combined deterministic automaton.

The rules' regexes become one nondeterministic automaton behind an unanchored prefix, then a deterministic one by subset
construction, then a minimal one by partition refinement, kept as transition arrays over byte classes.  One pass over
the bytes feeds all rules: a block of texts is cut into lanes at bytes after which the automaton is always in its start
state, and all lanes step together.  Wherever a rule accepts, the match is resolved nearby with the rule's own anchored
automaton (leftmost start, longest end), so nothing else of a text is read twice.

Every row gives one result row: a null or empty text has no spans; texts of any length are scanned whole.  Rows with
equal ids are scanned each for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import text_blocks

# ---------------------------------------------------------------- regexes to automata


def chars(text: str) -> frozenset:
    return frozenset(text.encode())


LOWER, UPPER, DIGIT = (chars(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))


class Nfa:
    """A nondeterministic automaton over bytes, built from nested tuples.

    ("set", bytes), ("seq", r...), ("alt", r...), ("opt", r), ("star", r), ("plus", r), ("rep", r, n) [n or more]
    """

    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.empty) - 1

    def add(self, regex: tuple, start: int) -> int:
        """Adds regex from start; its end."""
        kind, *parts = regex
        if kind == "set":
            end = self.state()
            self.step[start].append((parts[0], end))
            return end
        if kind == "seq":
            for part in parts:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in parts:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        if kind == "opt":
            end = self.add(parts[0], start)
            self.empty[start].append(end)
            return end
        if kind == "rep":
            for _ in range(parts[1] - 1):
                start = self.add(parts[0], start)
            return self.add(("plus", parts[0]), start)
        if kind in ("star", "plus"):
            begin = self.state()
            self.empty[start].append(begin)
            end = self.add(parts[0], begin)
            self.empty[end].append(begin)
            if kind == "plus":
                return end
            out = self.state()
            self.empty[begin].append(out)
            self.empty[end].append(out)
            return out
        raise ValueError(kind)

    def closure(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """Transition arrays: table[state, byte class]; accepts[state] is a bit mask of rules; state 0 starts."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    dead: int = -1
    reset: np.ndarray = field(default=None)

    @property
    def bytes_table(self) -> np.ndarray:
        """Transitions on raw bytes, flat: [state << 8 | byte]."""
        return np.ascontiguousarray(self.table[:, self.classes].reshape(-1))


def compile_dfa(regexes: list[tuple], unanchored: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation by partition refinement."""
    nfa = Nfa()
    start, ends = nfa.state(), {}
    for k, regex in enumerate(regexes):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        ends[nfa.add(regex, begin)] = k
    sets = {s for steps in nfa.step for s, _ in steps}
    marks = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    classes = np.array([kinds[m] for m in marks], np.uint8)
    sample = [marks.index(m) for m in kinds]
    first = nfa.closure([start])
    ids, todo, table, accepts = {first: 0}, [first], [], []
    for now in todo:
        accepts.append(sum({1 << ends[x] for x in now if x in ends}))
        row = []
        for byte in sample:
            to = {t for x in now for s, t in nfa.step[x] if byte in s} | ({start} if unanchored else set())
            to = nfa.closure(to)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        table.append(row)
    table, block = np.array(table), np.unique(np.array(accepts), return_inverse=True)[1]
    while True:  # states of a block stay together while their rows lead to the same blocks
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    order = list(dict.fromkeys(block.tolist()))
    rank = {b: i for i, b in enumerate(order)}
    block = np.array([rank[b] for b in block.tolist()])
    pick = [int(np.flatnonzero(block == i)[0]) for i in range(len(order))]
    small = block[table[pick]].astype(np.int32)
    dfa = Dfa(classes, small, np.array(accepts)[pick].astype(np.int64))
    stuck = [i for i in range(len(small)) if not dfa.accepts[i] and (small[i] == i).all()]
    dfa.dead = stuck[0] if stuck and not unanchored else -1
    dfa.reset = (small == 0).all(axis=0)[classes]
    return dfa


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """kind, its regex, and how many characters the whole match, or its trailing run over tail, needs at least."""

    kind: str
    regex: tuple
    least: int = 0
    tail: frozenset | None = None
    tail_least: int = 0


def _word(text: str, any_case: bool = True) -> tuple:
    return ("seq", *(("set", chars(c.lower() + c.upper()) if any_case and c.isalpha() else chars(c)) for c in text))


_VALUE = LOWER | UPPER | DIGIT | chars("+/_.=-")
_TOKEN = LOWER | UPPER | DIGIT | chars("_-")
_QUOTE = ("opt", ("set", chars("\"'")))
_BLANKS = ("star", ("set", chars(" ")))

#: The base kinds, in the order that breaks ties of spans.
BASE_RULES = (
    Rule(
        "assign",
        ("seq", ("alt", _word("password"), _word("passwd"), _word("secret"), _word("token"), ("seq", _word("api"), ("opt", ("set", chars("_"))), _word("key"))), _QUOTE, _BLANKS, ("set", chars(":=")), _BLANKS, _QUOTE, ("plus", ("set", _VALUE))),
        tail=_VALUE,
        tail_least=12,
    ),
    Rule("access", ("seq", _word("AKIA", False), ("plus", ("set", UPPER | DIGIT))), least=18),
    Rule("hex", ("plus", ("set", DIGIT | chars("abcdef"))), least=16),
)

#: What the scan adds: key blocks and tokens with a public, fixed prefix.
MORE_RULES = (
    Rule("private_key", ("seq", _word("-----BEGIN ", False), ("star", ("set", UPPER | chars(" "))), _word("PRIVATE KEY-----", False))),
    Rule("jwt", ("seq", _word("eyJ", False), ("plus", ("set", _TOKEN)), ("set", chars(".")), ("plus", ("set", _TOKEN)), ("set", chars(".")), ("plus", ("set", _TOKEN))), least=40),
    Rule("git_token", ("seq", _word("gh", False), ("set", chars("pousr")), _word("_", False), ("plus", ("set", LOWER | UPPER | DIGIT))), least=40),
    Rule("chat_token", ("seq", _word("xox", False), ("set", chars("baprs")), _word("-", False), ("plus", ("set", LOWER | UPPER | DIGIT | chars("-")))), least=15),
    Rule("maps_key", ("seq", _word("AIza", False), ("plus", ("set", _TOKEN))), least=39),
)


class Scanner:
    """All rules in one automaton, over blocks of texts."""

    LANE_BYTES = 512

    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.rules = rules
        self.kinds = [r.kind for r in rules]
        # All rules together look for what a match begins with; longest() then takes the rest of its last run.
        self.all = compile_dfa([self._shortest(r) for r in rules], unanchored=True)
        self.single = [compile_dfa([r.regex], unanchored=False) for r in rules]
        self.firsts = [frozenset(b for b in range(256) if d.table[0, d.classes[b]] != d.dead) for d in self.single]
        self.flat = self.all.bytes_table
        self.hot = self.all.accepts > 0

    @staticmethod
    def _shortest(rule: Rule) -> tuple:
        """What a match of the rule begins with: up to the first character of its last run, or a run's least length."""
        if rule.regex[0] == "plus":
            return ("rep", rule.regex[1], max(1, rule.least))
        *head, last = rule.regex[1:]
        return ("seq", *head, last[1] if last[0] == "plus" else last)

    def stops(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of a last byte) at which rules accept, ascending, and the rules' bit masks.

        Lanes begin at texts' starts or after bytes that always lead to the start state.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        safe = self.all.reset[data]
        cut = np.flatnonzero(safe) + 1
        cut = np.unique(np.concatenate([cut, offsets[offsets < n]]))
        cut = cut[cut < n]
        keep = np.searchsorted(cut, np.arange(0, n, self.LANE_BYTES))
        starts = np.unique(np.concatenate([cut[keep[keep < len(cut)]], offsets[offsets < n], [0]]))
        ends = np.append(starts[1:], n)
        order = np.argsort(starts - ends, kind="stable")  # longest lanes first, so that the live ones stay in front
        starts, ends = starts[order], ends[order]
        lengths = ends - starts
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        state, found, where = np.zeros(len(starts), np.int32), [], []
        for t in range(int(lengths[0])):
            k = live[t]
            at = starts[:k] + t
            now = self.flat[(state[:k] << 8) | data[at]]
            state[:k] = now
            hit = self.hot[now]
            if hit.any():
                where.append(at[hit])
                found.append(self.all.accepts[now[hit]])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, found = np.concatenate(where), np.concatenate(found)
        order = np.argsort(where, kind="stable")
        return where[order], found[order]

    def longest(self, rule: int, data: bytes, start: int) -> int:
        """End of the longest match of the rule from start, or -1."""
        dfa, state, end = self.single[rule], 0, -1
        classes, table, accepts, dead = dfa.classes, dfa.table, dfa.accepts, dfa.dead
        for i in range(start, len(data)):
            state = table[state, classes[data[i]]]
            if state == dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    def spans(self, data: bytes, stops: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of one text, leftmost and non-overlapping per rule, from its accepting positions."""
        out = []
        for k, rule in enumerate(self.rules):
            done = 0
            for stop, mask in stops:
                if not mask >> k & 1 or stop < done:
                    continue
                begin = self.leftmost(k, data, stop + 1, done)
                if begin < 0:
                    continue
                end = self.longest(k, data, begin)
                done = end
                if end - begin >= rule.least and (not rule.tail or self._tail(rule, data, begin, end) >= rule.tail_least):
                    out.append((begin, end, k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def leftmost(self, rule: int, data: bytes, end: int, floor: int) -> int:
        """Leftmost start, from floor on, of a match of the rule that ends at end (a match holds no byte that resets)."""
        low = end - 1
        reset = self.all.reset
        while low > floor and not reset[data[low - 1]]:
            low -= 1
        first = self.firsts[rule]
        for start in range(low, end):
            if data[start] in first and self._matches(rule, data, start, end):
                return start
        return -1

    def _matches(self, rule: int, data: bytes, start: int, end: int) -> bool:
        dfa, state = self.single[rule], 0
        for i in range(start, end):
            state = dfa.table[state, dfa.classes[data[i]]]
            if state == dfa.dead:
                return False
        return bool(dfa.accepts[state])

    @staticmethod
    def _tail(rule: Rule, data: bytes, start: int, end: int) -> int:
        """Characters of the value: what follows the first separator, its blanks and an opening quote."""
        i = start
        while data[i] not in b":=":
            i += 1
        i += 1
        while data[i] == 0x20:
            i += 1
        return end - i - (data[i] in b"\"'")

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
        """(row, text in UTF-8, spans) of the rows that have spans."""
        for first, data, offsets in text_blocks(texts, 1 << 20):
            where, masks = self.stops(data, offsets)
            rows = np.searchsorted(offsets, where, side="right") - 1
            for row in np.unique(rows).tolist():
                low, high = np.searchsorted(rows, [row, row + 1])
                begin = int(offsets[row])
                text = data[begin : int(offsets[row + 1])].tobytes()
                yield first + row, text, self.spans(text, list(zip((where[low:high] - begin).tolist(), masks[low:high].tolist(), strict=True)))


def _digest(kinds: list[str], spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in whole texts: id, n_assign, n_access, n_hex, base_sha256, spans, found (kind, start, end, text).

    Spans are code points, end exclusive, by start and then kind in the rules' order.
    """
    base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans, found = np.zeros((base, n), np.int64), [none] * n, [""] * n, [[] for _ in range(n)]
            for row, text, hits in scanner.scan(batch.column(1)):
                if not text.isascii():
                    # Matches are ASCII; what precedes one is what precedes the last, and the code points between.
                    lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    places = [int(lead[a - 1]) if a else 0 for a, _, _ in hits]
                    hits = [(at, at + b - a, k) for at, (a, b, k) in zip(places, hits, strict=True)]
                whole = text.decode()
                own = [x for x in hits if x[2] < base]
                for _, _, k in own:
                    counts[k, row] += 1
                digests[row] = hashlib.sha256(_digest(scanner.kinds, own).encode()).hexdigest()
                spans[row] = _digest(scanner.kinds, hits)
                found[row] = [{"kind": scanner.kinds[k], "start": a, "end": b, "text": whole[a:b]} for a, b, k in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans), pa.array(found, _FOUND)],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,text:string>>"
    )


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
