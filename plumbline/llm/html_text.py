"""Main text of web pages by union-free regular expressions inferred per host.

A page is read as a stream of tags and texts, nested by its block elements.  Within an element, neighbouring runs of like items become
one repeated group; what the pages of a host have there is aligned, item by item, and each mismatch is resolved: an item that
only some have becomes optional, another number of repeats a repeated group, differing texts a text slot.  The wrapper, one
expression for a host, says of each slot whether its text is the same on every page, and of each element how much changing
text it holds.  From that it decides where the main text is: the landmark elements (article, main, content by name) that hold
enough of the changing text, or else the smallest element that holds nearly all of it; slots of constant text, but for headings in a landmark, are
left out.
A page is then matched with its host's wrapper, place by place, and gives the texts of the places that the wrapper chose.
Elements named as page furniture (by tag, class, id or role) are left out on every page.

Inference is deterministic and the same for any partitioning: pages of one structure add up first (counts and checksums, in any
order), then the distinct structures of a host are aligned in the order of their hashes, within salts and then over the
salts, so a host with a third of all pages is no hot spot.  An element with more than WIDE items, or whose pages differ
that much, is matched by kinds of items instead of by place, so a wrapper's elements, the work of an alignment and its memory
stay bounded however long pages are.  Elements deeper than DEEP belong to the one at that depth.

A null or empty page has an empty text.  Pages of any length are read whole; rows with equal ids are worked on each for
itself; a page without a usable host forms the host "".  Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stash

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)|aria-hidden\s*=\s*[\"']?true", re.I)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav menu header footer aside form button input select option label fieldset dialog head script style noscript template iframe".split())
#: Words of class, id or role names that mark page furniture, and words that may follow them in such a name.
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert warning nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar aside widget widgets comment comments disqus replies reply respond discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login search form pagination pager toolbar complementary contentinfo skip hidden paywall copyright".split())
FILL_WORDS = frozenset("area bar block body bottom box button buttons container content form group icon icons inner item items left link links list main outer page panel right row section site slot small text title top unit wide wrap wrapper".split())
LAYOUT_WORDS = frozenset("has is no not with without".split())
LANDMARK_WORDS = frozenset("main article content post entry".split())
#: Elements of which a run is one repeated group whatever they hold; elements that a page has once, whatever their marks.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEM_TAGS = HEADINGS | frozenset("li p tr td th dt dd option".split())
SINGLE_TAGS = frozenset("html body main article".split())
#: An open element of the first kind ends where the next one begins, unless an element of SCOPES lies between.
ENDS = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th"}
SCOPES = frozenset("ul ol menu dl table article section main body div td th blockquote".split())
LONGEST_GROUP, WIDE, DEEP = 24, 100, 60
ARTICLE, MAIN, NAMED_CONTENT, DOMINANT = 1, 2, 4, 8
#: Share of the changing text that the landmarks of a kind must hold to be the main text, in order of precedence.
LEAST_SHARE = {ARTICLE: 0.25, MAIN: 0.25, NAMED_CONTENT: 0.5}


class Slot:
    """A text slot: pages that have it, code points, those in links, checksum while its text is the same on all pages."""

    __slots__ = ("n", "size", "linked", "check", "into", "bits", "drop")
    tag = "#"

    def __init__(self, n: int = 1, size: int = 0, linked: int = 0, check: int | None = 0):
        self.n, self.size, self.linked, self.check = n, size, linked, check
        self.into, self.bits, self.drop = None, 0, False


class Element:
    """An element, or a group of items ("()"): what its pages have in it, in order; optional where n is less than the parent's."""

    __slots__ = ("tag", "marks", "n", "kind", "repeated", "loose", "kids", "into", "bits")

    def __init__(self, tag: str, marks: tuple = (), kind: int = 0, kids: list | None = None):
        self.tag, self.marks, self.kind, self.kids = tag, marks, kind, [] if kids is None else kids
        self.n, self.repeated, self.loose, self.into, self.bits = 1, False, False, None, 0


# ---------------------------------------------------------------- pages


@functools.lru_cache(1 << 14)
def name_kind(token: str) -> str:
    """What a class, id or role name says of its element: "furniture", "content" or nothing."""
    words = [w for w in re.split(r"[-_]+", token) if w]
    if not words or words[0] in LAYOUT_WORDS:
        return ""
    if words[-1] in FURNITURE_WORDS or words[0] in FURNITURE_WORDS and all(w in FURNITURE_WORDS or w in FILL_WORDS or w.isdigit() for w in words[1:]):
        return "furniture"
    return "content" if words[0] in LANDMARK_WORDS else ""


@functools.lru_cache(1 << 14)
def features(name: str, attributes: str) -> tuple[tuple, int, bool]:
    """marks (class names without digits), kind of landmark, furniture."""
    marks, names = [], set()
    if "=" in attributes:
        for what, a, b, c in NAMED.findall(attributes):
            tokens = (a or b or c).lower().split()
            names |= {name_kind(t) for t in tokens}
            if what.lower() == "class":
                marks += [t for t in tokens if not any(x.isdigit() for x in t)]
            if what.lower() == "role" and "main" in tokens:
                names.add("role")
    hidden = "hidden" in attributes.lower() and bool(HIDDEN.search(attributes))
    kind = ARTICLE if name == "article" else MAIN if name == "main" or "role" in names else NAMED_CONTENT if "content" in names and name in BLOCKS and name not in ("html", "body") else 0
    furniture = name in FURNITURE or hidden or "furniture" in names and name not in SINGLE_TAGS
    return tuple(sorted(set(marks))), kind, furniture


def read_page(page: str) -> tuple[Element, list]:
    """The tree of a page's block elements with its slots, and its texts in order: (text, slot); None ends a block."""
    root, events = Element(""), []
    stack: list[tuple] = []  # name, is a block, inside furniture, inside a link, element
    blocks: list[int] = []  # places of block elements in the stack
    opened: dict[str, int] = {}
    node, furniture, linked, depth = root, False, False, 0

    def pop_to(at: int) -> None:
        nonlocal node, furniture, linked
        for name, *_ in stack[at:]:
            opened[name] -= 1
        del stack[at:]
        while blocks and blocks[-1] >= at:
            blocks.pop()
        _, _, furniture, linked, node = stack[-1] if stack else ("", False, False, False, root)

    def text(value: str) -> None:
        if furniture:
            return
        if value.isspace():
            events.append((value, None))
            return
        if not node.kids or node.kids[-1].tag != "#":
            node.kids.append(Slot())
        slot, plain = node.kids[-1], value.strip()
        slot.size += len(plain)
        slot.linked += len(plain) if linked else 0
        slot.check = zlib.crc32(plain.encode("utf-8", "surrogatepass"), slot.check)
        events.append((value, slot))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        block = name in BLOCKS
        if m[2]:
            if not opened.get(name):
                events.append(None) if block else None
                continue
            if block:
                place = next(i for i in reversed(blocks) if stack[i][0] == name)
            else:  # an inline end tag reaches no further than its block
                low = max(blocks[-1] + 1 if blocks else 0, len(stack) - DEEP)
                place = next((i for i in range(len(stack) - 1, low - 1, -1) if stack[i][0] == name), None)
                if place is None:
                    continue
            events.append(None) if block else None
            pop_to(place)
            continue
        if block:
            events.append(None)
            ends = ENDS.get(name, "").split() + (["p"] if name not in ("td", "th", "tr") else [])
            for i in reversed(blocks[-4:]):
                if stack[i][0] in ends:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        elif name == "br":
            events.append((" ", None))
        if name in VOID:
            continue
        marks, kind, own = features(name, m[4] or "")
        inner = node
        if block and not furniture and len(blocks) < DEEP:
            inner = Element(name, marks, kind)
            node.kids.append(inner)
        if block:
            blocks.append(len(stack))
        opened[name] = opened.get(name, 0) + 1
        furniture, linked, node = furniture or own, linked or name == "a", inner
        stack.append((name, block, furniture, linked, inner))
    if at < len(page):
        text(page[at:])
    fold(root)
    return root, events


# ---------------------------------------------------------------- expressions


def key(item: Slot | Element) -> tuple:
    """Tag and marks of an item, or of the items of a group."""
    if item.tag == "()":
        return ("()", *map(key, item.kids))
    return ("#",) if item.tag == "#" else (item.tag,) if item.tag in SINGLE_TAGS else (item.tag, *item.marks)


def like(item: Slot | Element) -> tuple:
    """What must be equal for neighbours to be repeats of one item."""
    if item.tag in ("#", "()") or item.tag in ITEM_TAGS:
        return key(item)
    return (*key(item), "/", *sorted({x.tag for x in item.kids}))


REPEAT = re.compile(r"(.{1,%d}?)\1+" % LONGEST_GROUP, re.S)


def fold(node: Element) -> None:
    """Neighbouring runs of like items, of up to LONGEST_GROUP items each, become repeated groups, in all elements below."""
    for kid in node.kids:
        if kid.tag != "#":
            fold(kid)
    changed = True
    while changed and len(node.kids) > 1:
        names: dict[tuple, int] = {}
        code = "".join(chr(0x20000 + names.setdefault(like(x), len(names)) % 0x80000) for x in node.kids)
        if len(names) == len(node.kids):
            break
        out, at, changed = [], 0, False
        for m in REPEAT.finditer(code):
            out += node.kids[at : m.start()]
            size, items = len(m[1]), node.kids[m.start() : m.end()]
            group = items[0] if size == 1 else Element("()", kids=items[:size])
            for i in range(size, len(items), size):
                absorb(group, items[i] if size == 1 else Element("()", kids=items[i : i + size]), True)
            group.repeated = True
            out.append(group)
            at, changed = m.end(), True
        node.kids = out + node.kids[at:]
    if len(node.kids) > WIDE:
        loosen(node)


def loosen(node: Element) -> None:
    """One item for each kind: the element is matched by kinds from now on."""
    if not node.loose:
        node.loose, kids = True, node.kids
        node.kids = []
        _by_kind(node, kids, True)


def _by_kind(node: Element, kids: list, within: bool) -> None:
    known = {x.tag: x for x in node.kids}
    met = set()
    for kid in kids:
        for item in kid.kids if kid.tag == "()" else [kid]:
            if item.tag in known:
                absorb(known[item.tag], item, within or item.tag in met)
                if item.tag != "#" and item.tag in met:
                    known[item.tag].repeated = True
            else:
                known[item.tag] = item
                node.kids.append(item)
            met.add(item.tag)


def absorb(a: Slot | Element, b: Slot | Element, within: bool) -> None:
    """Adds b to a: another repeat within a page, or what other pages have in this place."""
    b.into = a
    a.n = max(a.n, b.n) if within else a.n + b.n
    if a.tag == "#":
        a.size, a.linked = a.size + b.size, a.linked + b.linked
        if within:
            a.check = None if a.check is None or b.check is None else zlib.crc32(b.check.to_bytes(4, "big"), a.check)
        elif a.check != b.check:
            a.check = None
        return
    a.marks = tuple(m for m in a.marks if m in b.marks)
    a.kind, a.repeated = a.kind or b.kind, a.repeated or b.repeated
    if a.loose or b.loose:
        loosen(a)
        _by_kind(a, b.kids, within)
        return
    _same_groups(a, b)
    kids = []
    for i, j in align(a.kids, b.kids):
        if i is not None and j is not None:
            absorb(a.kids[i], b.kids[j], within)
        kids.append(a.kids[i] if i is not None else b.kids[j])
    a.kids = kids
    if len(kids) > WIDE:
        loosen(a)


def _same_groups(a: Element, b: Element) -> None:
    """Where one side has found a group of several items, single occurrences of it on the other side are that group too."""
    for x, y in ((a, b), (b, a)):
        for group in [k for k in x.kids if k.tag == "()"]:
            want, out, i = [key(k) for k in group.kids], [], 0
            while i < len(y.kids):
                if [key(k) for k in y.kids[i : i + len(want)]] == want:
                    out.append(Element("()", kids=y.kids[i : i + len(want)]))
                    i += len(want)
                else:
                    out.append(y.kids[i])
                    i += 1
            y.kids = out


def likeness(a: tuple, b: tuple) -> int:
    """How well two items fit in one place, 0 if not at all: by tag, marks and the tags of what is in them."""
    (tag, marks, inner, name), (tag_b, marks_b, inner_b, name_b) = a, b
    if tag != tag_b or tag == "()" and name != name_b:
        return 0
    if tag in SINGLE_TAGS:
        return 40
    if marks != marks_b and marks and marks_b and not marks & marks_b:
        return 0
    both = len(inner | inner_b)
    return 10 + (10 * len(inner & inner_b) // both if both else 10) + (5 if marks == marks_b else 0)


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Places of both lists in one order: the alignment whose items fit best.

    The table has at most WIDE * WIDE cells: longer lists are loose.
    """
    shown = [[(x.tag, frozenset(x.marks), frozenset(k.tag for k in x.kids), key(x)) if x.tag != "#" else ("#", frozenset(), frozenset(), None) for x in s] for s in (a, b)]
    fits_a, fits_b = shown
    low = 0
    while low < min(len(a), len(b)) and fits_a[low] == fits_b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and fits_a[-1 - end] == fits_b[-1 - end]:
        end += 1
    n, m = len(a) - end, len(b) - end
    fit = [[likeness(fits_a[i], fits_b[j]) for j in range(low, m)] for i in range(low, n)]
    best = [[0] * (m - low + 1) for _ in range(n - low + 1)]
    for i in range(n - low - 1, -1, -1):
        row, under, good = best[i], best[i + 1], fit[i]
        for j in range(m - low - 1, -1, -1):
            row[j] = max(under[j], row[j + 1], under[j + 1] + good[j] if good[j] else 0)
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(low)]
    i = j = 0
    while i < n - low or j < m - low:
        if i < n - low and j < m - low and fit[i][j] and best[i][j] == best[i + 1][j + 1] + fit[i][j]:
            out.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif i < n - low and best[i][j] == best[i + 1][j]:
            out.append((low + i, None))
            i += 1
        else:
            out.append((None, low + j))
            j += 1
    out.extend((n + i, m + i) for i in range(end))
    return out


# ---------------------------------------------------------------- wrappers


def dump(item: Slot | Element) -> list:
    if item.tag == "#":
        return ["#", item.n, item.size, item.linked, item.check]
    return [item.tag, item.n, list(item.marks), item.kind, int(item.repeated) + 2 * int(item.loose), [dump(k) for k in item.kids]]


def load(data: list) -> Slot | Element:
    if data[0] == "#":
        return Slot(*data[1:])
    tag, n, marks, kind, flags, kids = data
    out = Element(tag, tuple(marks), kind, [load(k) for k in kids])
    out.n, out.repeated, out.loose = n, bool(flags & 1), bool(flags & 2)
    return out


def structure(item: Slot | Element) -> list | str:
    return "#" if item.tag == "#" else [item.tag, item.marks, item.kind, item.repeated, item.loose, [structure(k) for k in item.kids]]


def structure_hash(root: Element) -> str:
    return hashlib.blake2b(json.dumps(structure(root)).encode(), digest_size=12).hexdigest()


def add_up(a: Slot | Element, b: Slot | Element) -> None:
    """Adds b to a where both have one structure: the same result in any order."""
    a.n += b.n
    if a.tag == "#":
        a.size, a.linked, a.check = a.size + b.size, a.linked + b.linked, a.check if a.check == b.check else None
    else:
        for x, y in zip(a.kids, b.kids, strict=True):
            add_up(x, y)


def slots_of(node: Element) -> Iterator[Slot]:
    for kid in node.kids:
        if kid.tag == "#":
            yield kid
        else:
            yield from slots_of(kid)


def decide(root: Element) -> dict:
    """What extraction needs of a wrapper: its expression with the regions that hold the main text and the slots to leave out."""
    pages, slots = root.n, list(slots_of(root))
    vary = any(s.check is None and s.n > 1 for s in slots)
    worth = lambda s: max(0, s.size - s.linked) if s.check is None or not vary or s.n == 1 else 0
    weights: dict[int, int] = {}
    titles: set[int] = set()

    def weigh(node: Element, bits: int) -> int:
        node.bits = bits | node.kind
        total = 0
        for kid in node.kids:
            if kid.tag == "#":
                kid.bits = node.bits
                total += worth(kid)
                if node.tag in HEADINGS and node.bits:
                    titles.add(id(kid))
            else:
                total += weigh(kid, node.bits)
        weights[id(node)] = total
        return total

    total = weigh(root, 0)
    held = {kind: sum(worth(s) for s in slots if s.bits & kind) for kind in LEAST_SHARE}
    levels = [kind for kind, share in LEAST_SHARE.items() if held[kind] and held[kind] >= share * total]
    region = root
    while (inner := next((k for k in region.kids if k.tag != "#" and k.tag not in ITEM_TAGS and total and weights[id(k)] >= 0.9 * total), None)) is not None:
        region = inner
    if region is not root and total:
        levels.append(DOMINANT)

        def mark(node: Element) -> None:
            node.bits |= DOMINANT
            for kid in node.kids:
                if kid.tag == "#":
                    kid.bits |= DOMINANT
                else:
                    mark(kid)

        mark(region)
    constant = [s for s in slots if vary and pages >= 3 and s.n == pages and s.check is not None and id(s) not in titles]
    for inside in (True, False):
        some = [s for s in slots if bool(levels and s.bits & levels[0]) == inside]
        here = [s for s in constant if s in some] if constant else []
        if sum(s.size for s in here) <= sum(s.size for s in some if s.check is None):
            for s in here:
                s.drop = True

    def slim(item: Slot | Element) -> list:
        return ["#", int(item.drop)] if item.tag == "#" else [item.tag, list(item.marks), item.bits, int(item.loose), [slim(k) for k in item.kids]]

    return {"levels": levels, "tree": slim(root)}


def load_rule(rule: dict) -> tuple[list[int], Element]:
    def grow(data: list) -> Slot | Element:
        if data[0] == "#":
            slot = Slot()
            slot.drop = bool(data[1])
            return slot
        tag, marks, bits, loose, kids = data
        out = Element(tag, tuple(marks), 0, [grow(k) for k in kids])
        out.bits, out.loose = bits, bool(loose)
        return out

    return rule["levels"], grow(rule["tree"])


def locate(wrapper: Element | None, node: Element, bits: int) -> None:
    """Matches a page's element with its place in the wrapper: its slots learn the regions they lie in and whether they are left out."""
    node.bits = bits | (wrapper.bits if wrapper is not None else node.kind)
    if wrapper is None:
        pairs = [(None, k) for k in node.kids]
    elif wrapper.loose or node.loose:
        known = {k.tag: k for x in reversed(wrapper.kids) for k in (x.kids if x.tag == "()" else [x])}
        pairs = [(known.get(k.tag), k) for x in node.kids for k in (x.kids if x.tag == "()" else [x])]
    else:
        if any(k.tag == "()" for k in wrapper.kids) or any(k.tag == "()" for k in node.kids):
            mine = Element("", kids=list(wrapper.kids))
            _same_groups(mine, node)
        else:
            mine = wrapper
        pairs = [(mine.kids[i] if i is not None else None, node.kids[j]) for i, j in align(mine.kids, node.kids) if j is not None]
    for place, kid in pairs:
        if kid.tag == "#":
            kid.bits, kid.drop = node.bits, place is not None and place.drop
        else:
            locate(place, kid, node.bits)


def main_text(page: str, rule: tuple[list[int], Element]) -> str:
    """Blocks of the main text by a host's rule, joined by line feeds; a page without text in any region is taken whole."""
    levels, wrapper = rule
    root, events = read_page(page)
    locate(wrapper, root, 0)
    for level in (*levels, 0):
        if found := _text_in(events, level):
            return found
    return ""


def _text_in(events: list, level: int) -> str:
    blocks, now, used = [], [], False
    for event in (*events, None):
        if event is None:
            if used:
                text = " ".join(entities.unescape("".join(now)).split())
                if text:
                    blocks.append(text)
            now, used = [], False
            continue
        value, slot = event
        if slot is not None:
            while slot.into is not None:
                slot = slot.into
            if slot.drop or level and not slot.bits & level:
                continue
            used = True
        now.append(value)
    return "\n".join(blocks)


# ---------------------------------------------------------------- tables


def host_column(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Structures that a task holds before it gives them up; groups of a host's structures that are aligned apart at first.
HELD, SALTS = 4096, 32
WRAPPER = "host string, salt int, name string, wrapper string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "salt", "name", "wrapper"])


def page_structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The structures of a task's pages, those of one host and structure added up."""
    held: dict[tuple[str, str], Element] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, int(name[:8], 16) % SALTS, name, json.dumps(dump(tree))) for (host, name), tree in held.items()]
        held.clear()
        return _batch(rows)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if page := page.as_py():
                tree, _ = read_page(page)
                at = host, structure_hash(tree)
                if at in held:
                    add_up(held[at], tree)
                else:
                    held[at] = tree
                if len(held) >= HELD:
                    yield out()
    if held:
        yield out()


def align_in_order(by_salt: bool):
    """Folds rows that are sorted by host, salt and name into one wrapper for each host and salt, or for each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, name, tree, done = None, None, None, None, []

        def finish() -> None:
            nonlocal whole, tree
            if tree is not None:
                if whole is None:
                    whole = tree
                else:
                    absorb(whole, tree, False)
            tree = None

        for batch in batches:
            for host, salt, new, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = (host, salt if by_salt else 0)
                if here != at:
                    finish()
                    if whole is not None:
                        done.append((*at, "", json.dumps(dump(whole))))
                    at, whole, name = here, None, None
                more = load(json.loads(data))
                if by_salt and tree is not None and new == name:
                    add_up(tree, more)
                else:
                    finish()
                    name, tree = new, more
            if len(done) > 1000:
                yield _batch(done)
                done = []
        finish()
        if whole is not None:
            done.append((*at, "", json.dumps(dump(whole))))
        if done:
            yield _batch(done)

    return run


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, rule (JSON) from all pages (host, html)."""

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(decide(load(json.loads(w)))) for w in batch.column(3).to_pylist()], pa.string())], ["host", "rule"])

    parts = pages.select("host", "html").mapInArrow(page_structures, WRAPPER)
    salted = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "name").mapInArrow(align_in_order(True), WRAPPER)
    whole = salted.repartition("host").sortWithinPartitions("host", "salt").mapInArrow(align_in_order(False), WRAPPER)
    return whole.mapInArrow(rules, "host string, rule string")


#: Rules of at most so many bytes in all are broadcast; more are joined by a shuffle over salted hosts.
BROADCAST_BYTES = 8 << 20


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_column(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    rules = stash(infer_wrappers(rows), "wrappers")
    size = rules.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(rules), "host", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")

    @F.arrow_udf("string")
    def text(html: pa.Array, rule: pa.Array) -> pa.Array:
        known: dict[str, tuple] = {}
        out = []
        for page, r in zip(html.to_pylist(), rule.to_pylist(), strict=True):
            if not page:
                out.append("")
                continue
            if r not in known:
                known[r] = load_rule(json.loads(r))
            out.append(main_text(page, known[r]))
        return pa.array(out, pa.string())

    texts = joined.select("page_id", "url", text("html", "rule").alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
