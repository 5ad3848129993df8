"""Personal data: base rules on whole texts, and a character tagger that adds the forms which the rules do not know.

The tagger (char_tagger) learns from the spans of the base rules in a bounded sample of documents and from other writings of
the same spans (marks in words, other signs between digits, numbers without a plus sign).  It reads windows around digits, at
signs and bracketed words `at`; a window without any of these holds no span.  Overlapping windows are decoded one by one and
reconciled over the whole text: pieces that a window's edge cuts are joined with those of the next window, and of what
overlaps the choice of the greatest total confidence stays.  A span that fails its kind's test of values (Luhn, 255, number of
digits) or overlaps a base span is dropped, so base spans always stay.

Null texts are empty; the id is carried as it is, repeated or null; texts of any length are worked on whole, memory follows one
text and TOGETHER windows.  A table without base spans gives no tagger and no added spans.  Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import char_tagger as tagger
from plumbline.llm.common import text_blocks

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Documents of the sample that the tagger learns from, the longest that is taken, and windows learned from.
FIT_ROWS, FIT_LONGEST, FIT_WINDOWS = 1500, 20_000, 2400
#: Characters around an anchor that a window must show; how sure the places of an added span must be on average.
MARGIN, CONFIDENT = 24, 0.8

LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]+|[(\[]\x20?[aA][tT]\x20?[)\]]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str, values: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base rules, by start and kind; without the tests of Luhn and 255 if values is false.

    Each rule is leftmost and non-overlapping.  The rules are written so that a long run is read once: an address is looked for
    from its at sign, an ip from the begin of a run of digits (from inside of one it cannot match if it does not from there).
    """
    out = []
    done = seen = 0
    at = text.find("@")
    while at >= 0:
        low = max(done, seen)
        start = low + len(text[low:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end(), EMAIL))
            done = found.end()
        seen = at + 1
        at = text.find("@", seen)
    for m in _IP.finditer(text):
        if not values or _small(m[0].split(".")):
            out.append((m.start(), m.end(), IP))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and (not values or luhn(digits)):
                out.append((m.start(), m.end(), CARD))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


def plausible(kind: int, text: str) -> bool:
    """Whether an added span passes the test of values of its kind."""
    digits = _digits(text)
    if kind == EMAIL:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[]\s?[aA][tT]\s?[)\]])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[]\s?[dD][oO][tT]\s?[)\]])\s?[A-Za-z0-9-]+)+", text) is not None
    if kind == IP:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and _small(parts)
    if kind == CARD:
        return 12 <= len(digits) <= 19 and luhn(digits) and re.search("[A-Za-z]", text) is None
    return 9 <= len(digits) <= 15 and re.search("[A-Za-z]", text) is None and text[0] in "(+0123456789"


# ---------------------------------------------------------------- windows


def window_starts(text: str) -> list[tuple[int, bool, bool]]:
    """(start, whether a window of the same region comes before, and after) of the windows of a text, in order.

    Regions are anchors with MARGIN characters around them; a region wider than a window gets windows that overlap by half.
    """
    regions: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        if regions and m.start() - MARGIN <= regions[-1][1]:
            regions[-1][1] = m.end() + MARGIN
        else:
            regions.append([m.start() - MARGIN, m.end() + MARGIN])
    out = []
    for a, b in regions:
        if b - a <= tagger.WIDTH:
            out.append((a - (tagger.WIDTH - (b - a)) // 2, False, False))
            continue
        starts = list(range(a, b - tagger.WIDTH // 2, tagger.WIDTH // 2))
        out += [(s, k > 0, k + 1 < len(starts)) for k, s in enumerate(starts)]
    return out


def window(text: str, start: int) -> np.ndarray:
    """Shapes of a window; PAD outside of the text."""
    out = np.full(tagger.WIDTH, tagger.PAD, np.uint8)
    low, high = max(start, 0), min(start + tagger.WIDTH, len(text))
    if low < high:
        out[low - start : high - start] = tagger.shapes(text[low:high])
    return out


def reconcile(found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """Spans of a text from the pieces of its windows: (start, end, kind, confidence, cut at the start, cut at the end).

    Pieces that are cut at facing edges and overlap are joined; what stays cut is dropped (a window that shows more has its say).
    Of the rest the non-overlapping choice with the greatest sum of log-odds is taken.
    """
    whole: dict[tuple[int, int, int], float] = {}
    open_: list[tuple[int, int, int, float]] = []  # pieces whose end is still to come
    for start, end, kind, sure, left, right in sorted(found):
        if left:
            before = [p for p in open_ if p[2] == kind and p[0] <= start <= p[1]]
            if not before:
                continue
            start, sure = before[-1][0], min(sure, before[-1][3])
        open_ = [p for p in open_ if p[1] >= start]
        if right:
            open_.append((start, end, kind, sure))
        else:
            whole[start, end, kind] = max(sure, whole.get((start, end, kind), 0.0))
    spans = sorted(((a, b, k, s) for (a, b, k), s in whole.items() if s >= CONFIDENT), key=lambda x: (x[1], x[0], x[2]))
    ends = [s[1] for s in spans]
    best: list[tuple[float, int]] = [(0.0, 0)]  # of the first spans: sum, and one more than the last that is taken
    for k, (start, _, _, sure) in enumerate(spans):
        before = int(np.searchsorted(ends[:k], start, side="right"))
        value = best[before][0] + math.log(sure / max(1 - sure, 1e-6))
        best.append((value, k + 1) if value > best[k][0] else (best[k][0], best[k][1]))
    out, at = [], len(spans)
    while best[at][1]:
        start, end, kind, _ = spans[best[at][1] - 1]
        out.append((start, end, kind))
        at = int(np.searchsorted(ends[: best[at][1] - 1], start, side="right"))
    return out[::-1]


def tag_texts(model: dict, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of texts by the tagger alone; windows of all texts are decoded together, TOGETHER at a time."""
    out: list[list[tuple[int, int, int]]] = []
    queue: list[tuple[int, int, bool, bool]] = []
    found: list[list[tuple]] = [[] for _ in texts]

    def work() -> None:
        tags, sure = tagger.decode(model, np.stack([window(texts[row], start) for row, start, _, _ in queue]))
        for (row, start, before, after), tag, certain in zip(queue, tags, sure, strict=True):
            if tag.any():
                for a, b, kind in tagger.pieces(tag):
                    found[row].append((start + a, start + b, kind, float(certain[a:b].mean()), before and a == 0, after and b == tagger.WIDTH))
        queue.clear()

    for row, text in enumerate(texts):
        for start, before, after in window_starts(text):
            queue.append((row, start, before, after))
            if len(queue) == tagger.TOGETHER:
                work()
    if queue:
        work()
    for text, mine in zip(texts, found, strict=True):
        out.append([(a, b, k) for a, b, k in reconcile(mine) if a >= 0 and b <= len(text)])
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagger's spans that are plausible and overlap no base span."""
    out = []
    for a, b, kind in tagged:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b and plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y, _ in base):
            out.append((a, b, kind))
    return out


# ---------------------------------------------------------------- learning


def other_writing(kind: int, text: str, rng: np.random.Generator) -> str:
    """A span of a base rule written in a form that the rule does not know."""
    pick = int(rng.integers(4))
    if kind == EMAIL:
        name, host = text.split("@", 1)
        at = (" (at) ", "[at]", " @ ", "(at)")[pick]
        dot = (" (dot) ", "[dot]", ".", ".")[pick]
        return name + at + host.replace(".", dot)
    if kind == IP:
        return text.replace(".", ("[.]", " . ", "[.]", "(.)")[pick])
    digits = _digits(text)
    if kind == CARD:
        return ("/", ".", "_", "  ")[pick].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    rest = digits[-7:]
    area = digits[:-7]
    return (f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"00{area} {rest[:3]} {rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}")[pick]


def plain_number(rng: np.random.Generator) -> str:
    """Digits that are no personal data: dates, times, versions, amounts, counts, identifiers."""
    n = lambda low, high: int(rng.integers(low, high))
    forms = (
        lambda: f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}", lambda: f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 100)}", lambda: f"{n(1, 100)},{n(0, 1000):03d},{n(0, 1000):03d}",
        lambda: str(n(0, 10**9)), lambda: f"({n(1, 2100)})", lambda: f"{n(0, 10**6) / 1000}", lambda: f"{n(1, 30)}/{n(1, 13)}/{n(1900, 2100)}", lambda: bytes(rng.integers(0, 256, 16, dtype=np.uint8)).hex(), lambda: f"{n(1, 100)}%",
        lambda: f"{n(1900, 2100)}-{n(1900, 2100)}", lambda: f"[{n(1, 100)}]", lambda: f"@user{n(1, 1000)}", lambda: f"{n(1, 10)} {n(1, 10)} {n(1, 10)}", lambda: f"ISO-{n(1000, 100000)}:{n(1900, 2100)}",
    )
    return forms[n(0, len(forms))]()


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from texts: base spans, other writings of them, digits that are none, and plain numbers put in.

    A check digit is beyond a reader of shapes, so spans that fail only the test of values are spans here; added ones are
    tested later.
    """
    rng = np.random.default_rng(3)
    windows, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]], middle: int) -> None:
        start = middle - int(rng.integers(4, tagger.WIDTH - 4))
        gold = np.zeros(tagger.WIDTH, np.uint8)
        for a, b, kind in spans:
            low, high = max(a - start, 0), min(b - start, tagger.WIDTH)
            if low < high:
                gold[low:high] = 2 + 2 * kind
                if a >= start:
                    gold[low] = 1 + 2 * kind
        windows.append(window(text, start))
        tags.append(gold)

    for text in texts:
        spans: list[tuple[int, int, int]] = []
        for span in sorted(base_spans(text, False), key=lambda s: (s[0], s[2] == CARD)):
            if not spans or span[0] >= spans[-1][1]:
                spans.append(span)
        for a, b, kind in [spans[k] for k in rng.permutation(len(spans))[:3]]:
            add(text, spans, (a + b) // 2)
            near = text[max(0, a - 80) : a], text[b : b + 80]
            other = other_writing(kind, text[a:b], rng)
            inside = near[0] + other + near[1]
            at = len(near[0])
            others = [(at, at + len(other), kind)]
            low, shift = a - at, len(other) - (b - a)
            others += [(x - low, y - low, k) for x, y, k in spans if y <= a and x >= low] + [(x - low + shift, y - low + shift, k) for x, y, k in spans if x >= b and y <= b + 80]
            add(inside, others, at + len(other) // 2)
        rest = [m.start() for m in _ANCHOR.finditer(text) if not any(a <= m.start() < b for a, b, _ in spans)]
        for k in rng.permutation(len(rest))[:2]:
            add(text, spans, rest[k])
        gap = text.find(" ", int(rng.integers(max(1, len(text)))))
        if gap >= 0 and not any(a < gap + 80 and b > gap - 80 for a, b, _ in spans):
            number = plain_number(rng)
            add(text[max(0, gap - 80) : gap] + " " + number + text[gap : gap + 80], [], min(gap, 80) + 1 + len(number) // 2)
        if len(windows) >= FIT_WINDOWS:
            break
    none = np.zeros((0, tagger.WIDTH), np.uint8)
    return (np.stack(windows), np.stack(tags)) if windows else (none, none)


def learn(texts: list[str]) -> dict | None:
    """The tagger from sample texts; None if they hold no base span."""
    x, gold = examples(texts)
    return tagger.train(x, gold, len(KINDS)) if gold.any() else None


def fit(docs: DataFrame, text_col: str = "text") -> dict | None:
    """The tagger, from FIT_ROWS texts with digits or at signs, half of them with more signs of personal data, in hash order; copies count once.

    It is fitted in one task of an executor; only its parameters (some 60 KB) come to the driver.
    """
    text = docs[text_col].cast("string")
    rows = docs.select(text.alias("text")).where((F.octet_length("text") <= FIT_LONGEST) & F.col("text").rlike("[0-9@]"))
    marked = F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]{12}|\+[0-9]")
    rows = rows.select("text", marked.alias("marked"), F.xxhash64("text").alias("hash"))
    kinds = rows.groupBy("marked").agg(F.approx_count_distinct("hash").alias("n")).collect()  # two rows
    order = [F.col("hash"), F.col("text")]
    picked = None
    for kind in kinds:
        # Few more than are taken pass by their hash, and copies are one, so that tasks have little to send.
        share = min(1.0, 2 * FIT_ROWS / max(kind.n, 1))
        some = rows.where((F.col("marked") == kind.marked) & (F.pmod("hash", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).groupBy("hash", "text").agg(F.count("*").alias("copies"))
        some = some.orderBy(*order).limit(FIT_ROWS // 2).select("hash", "text")
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(texts))], pa.binary())], ["model"])

    found = picked.repartition(1).sortWithinPartitions(*order).select("text").mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(found[0])) if found else None


# ---------------------------------------------------------------- scanning

FOUND = "array<struct<kind:string,start:long,end:long,text:string,base:boolean>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_())]))


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _marked_rows(texts: pa.Array) -> Iterator[list[int]]:
    """Rows that hold an anchor, by blocks of text."""
    hot = np.zeros(256, bool)
    hot[[*b"0123456789@([+"]] = True
    for first, data, offsets in text_blocks(texts, 1 << 20):
        count = np.concatenate([[0], np.cumsum(hot[data])])
        yield (first + np.flatnonzero(np.diff(count[offsets]))).tolist()


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """Personal data in whole texts: id, n_email, n_ip, n_card, n_phone, base_sha256 (base rules), spans and found (all).

    model: a tagger of fit() or learn(); without one only the base rules speak.  Spans are code points, end exclusive, by
    start and then kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans, found = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n, [[] for _ in range(n)]
            for rows in _marked_rows(batch.column(1)):
                texts = [batch.column(1)[row].as_py() for row in rows]
                tagged = tag_texts(model, texts) if model is not None else [[]] * len(rows)
                for row, text, more in zip(rows, texts, tagged, strict=True):
                    base = base_spans(text)
                    added = added_spans(text, base, more)
                    for _, _, kind in base:
                        counts[kind, row] += 1
                    digests[row] = hashlib.sha256(_digest(base).encode()).hexdigest()
                    both = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (s[0], s[2]))
                    spans[row] = _digest([s[:3] for s in both])
                    found[row] = [{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b], "base": own} for a, b, k, own in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans, pa.string()), pa.array(found, _FOUND)], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, spans string, found {FOUND}")
