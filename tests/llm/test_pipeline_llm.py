"""Toxicity scores against word-by-word sums, and the corpus pipeline on odd tables."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from plumbline.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, line string, rank int, cell long"


def brute_score(model, text):
    """One text, one word after another."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[a-zA-Z0-9\x80-\xff]+", data)]
    bare = np.frombuffer(data, np.uint8)
    _, _, _, sums = toxicity._HASHER.words(bare, np.array([0, len(data)]))
    key = lambda a, b: int(toxicity._HASHER.range(sums, np.array([a]), np.array([b]))[0])
    found, last, again = set(), None, 0
    for a, b in spans:
        word = key(a, b)
        again += word == last
        last = word
        found.add(word)
        for k in toxicity.BEGINNINGS:
            if b - a > k:
                found.add(int(toxicity.mix(np.array([key(a, a + k)], np.uint64) ^ np.uint64(k))[0]))
    words, size = max(1, len(spans)), max(1, len(data))
    style = [data.count(b"!") / words, sum(65 <= c <= 90 for c in data) / size, again / words, 1 / np.sqrt(words)]
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    value = sum(weights.get(k, 0.0) for k in found) + float(np.minimum(style, 1.0) @ model.styles) + model.bias
    return 1 / (1 + np.exp(-value))


def sample(rng, n=400):
    texts, y = [], []
    for _ in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "Delta", "eps", "zeta!", "éta"]) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.4
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grumf", "blarg", "snork"]) + rng.choice(["", "s", "ed"])
        texts.append(" ".join(words))
        y.append(int(bad))
    return texts, y


def test_scores_equal_word_by_word_sums():
    rng = random.Random(4)
    texts, y = sample(rng)
    model = toxicity.learn(pa.array(texts), np.array(y))
    assert len(model.keys)
    odd = ["", "!!!", "grumf grumf GRUMF", "a" * 5000 + " blarg", "é́ ½", " \n\t"]
    some = [*odd, *texts[:40]]
    got = toxicity.score_texts(model, pa.array([*some, None]))
    assert np.allclose(got[:-1], [brute_score(model, t) for t in some], atol=1e-9)
    assert got[-1] == got[0]


def test_the_fitting_sample_is_bounded_in_bytes(spark, monkeypatch):
    rng = random.Random(5)
    texts, y = sample(rng)
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t + " and more") for i, t in enumerate(texts[:50])] + [(900, "grumf " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(900, 1), (900, 0)], "doc_id long, toxic int")
    one, two = (toxicity.fit(docs.repartition(k), labels) for k in (1, 3))
    assert np.array_equal(one.keys, two.keys) and np.allclose(one.weights, two.weights)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 10)
    assert not len(toxicity.fit(docs, labels).keys)


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, repeated ids, a very long line, columns whose names the operators use."""
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega"]) + str(rng.randrange(400))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "ab"[i % 2], None, "x", "y", 1, 2) for i in range(30)]
    rows += [rows[3], rows[3], (4, "another text of this id", None, None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None), (None, "no id at all", "en", "a", 1, "", "", 0, 0)]
    rows += [(50, "", "en", "a", 0, "", "", 0, 0), (51, None, "en", None, None, None, None, None, None), (52, "\n\n \n", "en", "b", 4, None, None, None, None), (53, "longword" * 20_000, "de", "b", None, None, None, None, None)]
    folder = tables(spark, tmp_path, rows, [(0, 1, 0), (None, None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert len(packed) == docs.count() and {r.doc_id for r in packed} >= {0, 53}
    room = {}
    for r in packed:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).collect() == []
