"""Personal data: base rules against their regexes, the tagger on texts that it did not learn from, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm import char_tagger, pii, queries

KIND = "doc_id long, text string, lang string, id string, found int"
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def check_digit(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def keep(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and check_digit(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def by_regex(text):
    found = sorted((m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES) for m in re.finditer(rule, text or "") if keep(kind, m[0]))
    return [(a, b, k) for a, k, b in found]


def sentences(rng, n):
    words = "the of a house river and we will Go nach über été niño see blue (maybe) item".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def personal(rng):
    number = "".join(rng.choice("0123456789") for _ in range(15))
    card = next(number + d for d in "0123456789" if check_digit(number + d))
    return rng.choice([
        f"{rng.choice(['ann', 'bob.lee', 'x_y', 'K7'])}{rng.randint(0, 99)}@{rng.choice(['mail', 'web', 'post'])}.{rng.choice(['example', 'site'])}.{rng.choice(['com', 'org', 'de'])}",
        ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        rng.choice([card, " ".join(card[k : k + 4] for k in range(0, 16, 4))]),
        f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
    ])


def document(rng):
    parts = [sentences(rng, rng.randint(5, 30))]
    for _ in range(rng.randint(0, 3)):
        parts += [personal(rng) if rng.random() < 0.7 else rng.choice(["12", "2021-03-04", "v1.2", "99%", "@home"]), sentences(rng, rng.randint(5, 30))]
    return " ".join(parts)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return pii.learn([document(rng) for _ in range(400)])


def test_base_rules_equal_their_regexes():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "..", "1", "12", "255", "256", "0007", "1.2.3.4", "300.1.1.1", "+", "+4", " ", "-", "(", ")", "x@y.z", "_", "%", "é", "𝒳", "4111 1111 1111 1111", "4111111111111111", "123456", "\n", "com", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == by_regex(text), text


def test_base_rules_read_long_runs_once():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 200_000, "a@" * 100_000, "+1" + " " * 300_000, "1 " * 200_000):
        assert len(pii.base_spans(text)) < 40_000


def test_gradients_of_the_tagger_are_differences():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in char_tagger.start_values(4).items()}
    x, gold, may = rng.integers(0, char_tagger.SYMBOLS, (2, char_tagger.WIDTH)), np.zeros((2, char_tagger.WIDTH), int), char_tagger.allowed(4)
    gold[0, 5], gold[0, 6:9], gold[1, 0:3], gold[1, 20] = 1, 2, 4, 7
    _, grads = char_tagger._loss(model, x, gold, may)
    for name in model:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in model[name].shape)
            if name == "table":
                at = (at[0], int(x[0, 3]), at[2])
            sides = []
            for step in (0.01, -0.01):
                moved = {k: v.copy() for k, v in model.items()}
                moved[name][at] += step
                sides.append(char_tagger._loss(moved, x, gold, may)[0])
            assert abs((sides[0] - sides[1]) / 0.02 - grads[name][at]) < 2e-3


def test_decoding_is_the_best_path_and_marginals_are_shares():
    rng = np.random.default_rng(4)
    model = char_tagger.start_values(1)
    model = {k: (v + rng.normal(0, 0.5, v.shape)).astype(np.float32) for k, v in model.items()}
    x = rng.integers(0, char_tagger.SYMBOLS, (3, 7)).astype(np.uint8)
    tags, sure = char_tagger.decode(model, x)
    scores = char_tagger._lstm(model, x, False)[0] @ model["out"] + model["bias"]
    may = char_tagger.allowed(1)
    for row in range(3):
        paths = {}
        for code in range(3**7):
            path = [code // 3**t % 3 for t in range(7)]
            if all(may[a, b] for a, b in zip(path, path[1:])):
                paths[tuple(path)] = float(model["begin"][path[0]] + sum(scores[row, t, p] for t, p in enumerate(path)) + sum(model["trans"][a, b] for a, b in zip(path, path[1:])))
        assert tuple(tags[row]) == max(paths, key=paths.get)
        total = sum(np.exp(v) for v in paths.values())
        for t in range(7):
            alike = sum(np.exp(v) for p, v in paths.items() if (p[t] == 0) == (tags[row, t] == 0)) / total
            assert abs(alike - sure[row, t]) < 1e-3


def test_windows_are_reconciled_over_the_text():
    whole = [(10, 20, 0, 0.99, False, False), (12, 30, 1, 0.9, False, False), (25, 40, 0, 0.99, False, False)]
    assert pii.reconcile(whole) == [(10, 20, 0), (25, 40, 0)]
    cut = [(50, 64, 0, 0.95, False, True), (40, 90, 0, 0.2, False, False), (52, 80, 0, 0.99, True, False), (100, 128, 2, 0.99, True, False), (200, 210, 3, 0.99, False, True)]
    assert pii.reconcile(cut) == [(50, 80, 0)]
    assert pii.reconcile([]) == []


def test_the_tagger_finds_what_it_did_not_learn_from(model):
    rng, other = random.Random(3), np.random.default_rng(6)
    texts = [document(rng) for _ in range(200)]
    found = hits = wrong = 0
    again = seen = 0
    for text, spans in zip(texts, pii.tag_texts(model, texts)):
        base = pii.base_spans(text)
        found, hits = found + len(base), hits + len(set(base) & set(spans))
        wrong += len(pii.added_spans(text, base, spans))
        for a, b, kind in base[:1]:
            written = pii.other_writing(kind, text[a:b], other)
            changed = text[:a] + written + text[b:]
            if pii.plausible(kind, written) and (a, a + len(written), kind) not in pii.base_spans(changed):
                again += 1
                seen += (a, a + len(written), kind) in pii.added_spans(changed, pii.base_spans(changed), pii.tag_texts(model, [changed])[0])
    assert hits > 0.75 * found and wrong <= 2
    assert seen > 0.5 * again


def test_clean_texts_stay_clean(model):
    rng, numbers = random.Random(8), np.random.default_rng(8)
    texts = [sentences(rng, 30) + " " + pii.plain_number(numbers) + " " + sentences(rng, 30) for _ in range(300)]
    extra = [pii.added_spans(t, pii.base_spans(t), s) for t, s in zip(texts, pii.tag_texts(model, texts))]
    assert sum(map(bool, extra)) <= 3


def test_scan_equals_the_regexes_on_odd_rows(spark, model):
    rng = random.Random(9)
    rows = [(i, document(rng)) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "a@b.cd"), (502, "x@y.zz " * 4000 + "é 1.2.3.4"), (503, "1" * 50_000), (504, "same 10.0.0.1"), (504, "same 10.0.0.1"), (505, "Ünï 𝒳 mail a.b@c.de, tel +49 (030) 123-4567")]
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], KIND)
    got = pii.scan_pii(df, model=model).collect()
    assert sorted(map(str, (r.id for r in got))) == sorted(str(i) for i, _ in rows)
    texts = {str(i): t for i, t in rows}
    for r in got:
        text = texts[str(r.id)]
        want = by_regex(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in want) for kind in range(4)]
        line = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
        assert [(f.kind, f.start, f.end) for f in r.found if f.base] == [(RULES[k][0], a, b) for a, b, k in want]
        assert all(text[f.start : f.end] == f.text for f in r.found)
        assert ",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.found) == r.spans


def test_without_base_spans_there_is_no_tagger(spark):
    df = spark.createDataFrame([(1, "nothing here 12", "en", "x", 1), (2, None, "en", "x", 1)], KIND)
    assert pii.fit(df) is None
    assert [r.spans for r in pii.scan_pii(df, model=None).collect()] == ["", ""]
    assert pii.fit(df.limit(0)) is None and not pii.scan_pii(df.limit(0)).collect()


def test_the_query_equals_the_regexes(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_personal_data(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = by_regex(texts[r.doc_id])
        line = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
