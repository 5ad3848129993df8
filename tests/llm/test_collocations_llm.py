"""Collocations against plain counting and their SQL; automata against the tables that they stand for."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import collocations, count_automata, queries

KIND = "doc_id long, text string, lang string, rank int, phrase string"


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", low):
        words = re.findall("[^\x20\x09]+", piece)
        for i in range(len(words)):
            for k in (1, 2, 3):
                if i + k <= len(words):
                    yield tuple(words[i : i + k])


def expected(rows):
    counts = {}
    for _, text, lang in rows:
        counts.setdefault("und" if lang is None else lang, Counter()).update(grams(text))
    out = {}
    for lang, f in counts.items():
        n, kept = sum(v for p, v in f.items() if len(p) == 1), []
        longer = Counter()
        for p, v in f.items():
            if len(p) == 3 and v >= 10:
                for pair in (p[:2], p[1:]):
                    longer[pair] = max(longer[pair], v)
        for p, a in f.items():
            if len(p) == 1 or a < 10 or (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (s, a, p, left, right) in enumerate(sorted(kept)[:2000]):
            out[lang, k + 1] = (p.decode(), -a, left, right, n, -s)
    return out


def same(got, want):
    got = {(r["lang"], r["rank"]): (r["phrase"], r.a, r.l, r.r, r.n, r.score) for r in got}
    assert got == want


def automaton(phrases):
    """The automaton of a Counter of phrases (tuples of bytes), closed under beginnings with weight 0."""
    words = sorted({w for p in phrases for w in p})
    rank = {w: k for k, w in enumerate(words)}
    by = [[p for p in sorted(phrases) if len(p) == k] for k in (1, 2, 3)]
    rows = [np.array([[rank[w] for w in p] for p in ps], np.int64).reshape(-1, k + 1) for k, ps in enumerate(by)]
    return count_automata.assemble(pa.array(words, pa.binary()), rows, [np.array([phrases[p] for p in ps], np.int64) for ps in by], np.add)


def content(a):
    names = a.words.to_pylist()
    return Counter({tuple(names[x] for x in row): int(w) for d in range(3) for row, w in zip(count_automata.phrase_labels(a, d, np.arange(len(a.labels[d]))).tolist(), a.weights[d]) if w})


def test_automata_pack_cut_unite_prune_and_compose():
    rng = random.Random(2)
    letters = [bytes([c]) for c in b"abcdeg"] + ["é".encode(), b"aa"]
    for trial in range(60):
        parts = []
        for _ in range(3):
            c = Counter()
            for _ in range(rng.randint(0, 60)):
                c[tuple(rng.choice(letters) for _ in range(rng.randint(1, 3)))] += rng.randint(1, 6)
            parts.append(c)
        whole = sum(parts, Counter())
        a = count_automata.unite([automaton(c) for c in parts])
        assert content(a) == whole
        assert content(count_automata.unpack(count_automata.pack(a))) == whole
        cuts = sorted({tuple(rng.choice([*letters, b"", b"f", b"z"]) for _ in range(3)) for _ in range(trial % 7)})
        pieces = list(count_automata.sections(a, cuts))
        assert content(count_automata.unite([p for _, p in pieces] or [count_automata.empty()])) == whole
        for k, piece in pieces:
            held = content(piece)
            assert all(sum(c <= p for c in cuts) == k for p in held)
        assert {p: w for p, w in content(count_automata.prune(a, 5)).items() if w >= 5} == {p: w for p, w in whole.items() if w >= 5}
        asked = automaton(parts[0])
        arcs = count_automata.compose(asked, a)
        for d in range(3):
            names = asked.words.to_pylist()
            for row, arc in zip(count_automata.phrase_labels(asked, d, np.arange(len(asked.labels[d]))).tolist(), arcs[d]):
                phrase = tuple(names[x] for x in row)
                assert (int(a.weights[d][arc]) if arc >= 0 else 0) == whole[phrase]


def test_equal_states_are_one():
    many = Counter({(b"%05d" % k, b"x", b"y"): 1 for k in range(2000)} | {(b"%05d" % k, b"x"): 1 for k in range(2000)} | {(b"%05d" % k,): 1 for k in range(2000)})
    few = Counter({p: 1 + (int(p[0]) % 7 if len(p) > 1 else 0) for p in many})
    assert len(count_automata.pack(automaton(many))) < len(count_automata.pack(automaton(few)))
    assert content(count_automata.unpack(count_automata.pack(automaton(few)))) == few


def test_blocks_cut_texts_without_losing_a_phrase():
    rng = random.Random(3)
    for size in (8, 40, 200):
        for text in ("a b c. " * 50, "a " * 200, "x" * 300 + " y z", "".join(rng.choice("ab .,\t") for _ in range(700)), "word" * 100, ""):
            data = np.frombuffer(text.encode(), np.uint8)
            parts = [collocations.count_block(b, own) for b, own in collocations.blocks(data, size)]
            got = content(count_automata.unite(parts)) if parts else Counter()
            assert got == Counter(tuple(w.encode() for w in p) for p in grams(text))


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)] + ["The", "É", "of-x", "a'b"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "de", None, "und", "en\0"])) for i in range(300)]
    rows += [(1000 + i, "New York City is big. New York State", "en") for i in range(25)] + [(2000, None, "en"), (2001, "", None), (2002, " .,\n", "fr"), (2003, "solo " * 3000, "fr"), (2003, "solo " * 3000, "fr")]
    return rows


def test_collocations_equal_plain_counting(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], KIND)
    same(collocations.mine_collocations(df).collect(), expected(rows))


def test_many_small_ranges_give_the_same(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], KIND).repartition(3)
    texts = collocations._texts(df, "text", "lang")
    monkeypatch.setattr(collocations, "RANGE_BYTES", 4096)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(collocations, "FAN", 3)
    monkeypatch.setattr(collocations, "REGROUPED_ARCS", 500)
    monkeypatch.setattr(collocations, "LOOKUP_ARCS", 300)
    ranges = collocations.find_ranges(texts)
    assert len(ranges.bounds) > 8
    same(collocations.mine_collocations(df).collect(), expected(rows))


def test_an_empty_table_gives_nothing(spark):
    assert not collocations.mine_collocations(spark.createDataFrame([], KIND)).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_the_query_equals_its_sql(spark):
    got = queries.op11_phrase_collocations(spark, "/root/testdata/sf0.001").collect()
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(collocations.REPORT_SQL).fetchall()
    assert got and sorted(map(tuple, got)) == sorted(want)
