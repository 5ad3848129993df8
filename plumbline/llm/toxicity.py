"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicon entries (words and word beginnings that the fitting sample ties to a class) and patterns of style.
The label model gives each voter a class-conditional vote distribution by expectation maximisation; voters that stay
correlated within the classes share one weight.  The given labels enter as one more voter of fixed reliability.  A
logistic regression on the features is then trained on the posterior labels and scores every document.

Fitting reads a bounded sample (FIT_ROWS labelled rows of each class by hash order, whole texts of at most FIT_LONGEST bytes,
FIT_BYTES in all) in one task; scoring reads every text whole.  A null or empty text is scored like a text without features.
Without labelled rows of both classes every score is 0.  Rows with one id are scored each by its text; the sample takes the
first of their texts.  Columns of other names, whatever they are, are carried along unread.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WordHasher, mix, text_blocks

#: Labelled rows of each class that are fitted on, at most; bytes of the longest text among them, and of all in order of hash.
FIT_ROWS, FIT_LONGEST, FIT_BYTES = 2000, 1 << 20, 64 << 20
#: Bytes of a word's beginning that count as features of their own.
BEGINNINGS = (4, 5, 6)
#: Features kept by evidence, and how many of them vote.
MOST_FEATURES, MOST_VOTERS = 2048, 64
#: Evidence in nats (times a feature's support, the divergence of its class share from the overall share).
LEAST_EVIDENCE = 11.5
#: Different words that a beginning needs among documents of class 1, and the share of them that one word may have.
LEAST_WORDS, MOST_ONE_WORD = 3, 0.7
#: How reliable the given labels are as a voter.  Fixed: it keeps several copies of one voter from becoming the class.
LABEL_RELIABILITY = 0.95

_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | frozenset(range(128, 256))
_HASHER = WordHasher(bytes(sorted(set(range(256)) - _LETTERS)), seed=11)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    styles: np.ndarray
    bias: float
    voters: list[dict]


STYLES = ("exclamations", "capitals", "repeats", "brevity")


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and keys of word and beginning features (only those whose low bits keep marks), and style values by row."""
    starts, ends, rows, sums = _HASHER.words(data, offsets)
    found_rows, found_keys = [], []
    words = None
    for k in (0, *BEGINNINGS):
        if k:
            long = np.flatnonzero(ends - starts > k)
            at = starts[long]
            keys, of = mix(_HASHER.range(sums, at, at + k) ^ np.uint64(k)), rows[long]
        else:
            keys, of = _HASHER.range(sums, starts, ends), rows
            words = keys
        if keep is not None:
            pick = keep[(keys & np.uint64(len(keep) - 1)).astype(np.int64)]
            keys, of = keys[pick], of[pick]
        found_rows.append(of)
        found_keys.append(keys)
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets)).astype(float)
    total = np.maximum(1, np.bincount(rows, minlength=n)).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    style = np.column_stack([count(data == 33) / total, count((data >= 65) & (data <= 90)) / size, np.bincount(rows[again], minlength=n) / total, 1 / np.sqrt(total)])
    return np.concatenate(found_rows), np.concatenate(found_keys), np.minimum(style, 1.0)


def _pairs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (row, key) pairs and style values of texts, by blocks: memory follows a block, not the sample."""
    for first, data, offsets in text_blocks(texts):
        r, k, s = features(data, offsets, None)
        order = np.lexsort((k, r))
        r, k = r[order], k[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        yield r[new] + first, k[new], s


def _counts(texts: pa.Array, use: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """In how many of the marked texts each key occurs: of the given sorted keys, or of all keys that occur in three or more."""
    if keys is not None:
        count = np.zeros(len(keys))
        for row, key, _ in _pairs(texts):
            key = key[use[row]]
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            if len(keys):
                np.add.at(count, at[keys[at] == key], 1)
        return keys, count
    found = np.sort(np.concatenate([key[use[row]] for row, key, _ in _pairs(texts)] or [np.zeros(0, np.uint64)]))
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(found)))
    return found[starts[count >= 3]], count[count >= 3].astype(float)


def _distinct_documents(texts: pa.Array) -> np.ndarray:
    """Marks the first of texts that share a minimum of any of eight orders of their 5-word runs: copies count once."""
    keep, least = np.ones(len(texts), bool), []
    for _, data, offsets in text_blocks(texts):
        starts, ends, rows, sums = _HASHER.words(data, offsets)
        words = _HASHER.range(sums, starts, ends)
        runs = sum(np.roll(words, -k) * np.uint64(2 * k + 3) for k in range(5))
        whole = np.roll(rows, -4) == rows
        whole[-4:] = False
        runs, rows = runs[whole], rows[whole]
        out = np.zeros((len(offsets) - 1, 8), np.uint64)
        if len(rows):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            for k in range(8):
                out[rows[first], k] = np.minimum.reduceat(mix(runs + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), first)
        least.append(out)
    least = np.concatenate(least)
    for k in range(8):
        full = np.flatnonzero(least[:, k])
        _, first = np.unique(least[full, k], return_index=True)
        again = np.ones(len(full), bool)
        again[first] = False
        keep[full[again]] = False
    return keep


def _broad(texts: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Marks the sorted keys that are words, or beginnings which several words share: one word's beginning says no more."""
    hits = [[], []]
    for _, data, offsets in text_blocks(texts):
        starts, ends, rows, sums = _HASHER.words(data, offsets)
        words = _HASHER.range(sums, starts, ends)
        for k in BEGINNINGS:
            long = np.flatnonzero(ends - starts > k)
            own = mix(_HASHER.range(sums, starts[long], starts[long] + k) ^ np.uint64(k))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            hits[0].append(at[hit])
            hits[1].append(words[long[hit]])
    broad = np.ones(len(keys), bool)
    of, words = map(np.concatenate, hits)
    for k in np.unique(of):
        count = np.unique(words[of == k], return_counts=True)[1]
        broad[k] = len(count) >= LEAST_WORDS and count.max() <= MOST_ONE_WORD * count.sum()
    return broad


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 3, steps: int = 20) -> tuple[np.ndarray, list[dict]]:
    """Posterior of class 1 by row, and each voter's accuracy and shared weight.

    votes: rows x voters of -1 (abstains), 0, 1.  Votes are independent within a class up to the weights: voters whose
    votes stay correlated given the class form a group, and a group of g voters counts as one voter (weights 1/g).
    """
    n, m = votes.shape
    weight, posterior = np.ones(m), np.where(labels == 1, LABEL_RELIABILITY, 1 - LABEL_RELIABILITY)
    gold = np.log(LABEL_RELIABILITY / (1 - LABEL_RELIABILITY)) * np.where(labels == 1, 1, -1)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    table = None
    for again in range(rounds):
        for _ in range(steps):
            share = np.clip(posterior.mean(), 0.01, 0.99)
            by = [posterior, 1 - posterior]
            table = np.stack([(np.einsum("n,nmv->mv", p, hot) + 0.5) / (p.sum() + 1.5) for p in by])  # class 1, class 0
            ratio = np.log(table[0]) - np.log(table[1])
            score = np.einsum("nmv,mv,m->n", hot, ratio, weight) + np.log(share / (1 - share)) + gold
            new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            if np.abs(new - posterior).max() < 1e-6:
                break
            posterior = new
        if again == rounds - 1 or m < 2:
            break
        value = (votes == 1).astype(float) - (votes == 0)
        rest = value - posterior[:, None] * ((posterior @ value) / max(posterior.sum(), 1e-9)) - (1 - posterior)[:, None] * (((1 - posterior) @ value) / max((1 - posterior).sum(), 1e-9))
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        tied = np.abs(rest.T @ rest / n / scale[:, None] / scale) > 0.35
        np.fill_diagonal(tied, True)
        group = np.arange(m)
        for _ in range(m):
            new = np.array([group[t].min() for t in tied])
            if (new == group).all():
                break
            group = new
        weight = 1 / np.bincount(group, minlength=m)[group]
    return posterior, [{"accuracy": float(table[0][j, 2] / (table[0][j, 2] + table[1][j, 2])), "weight": float(weight[j])} for j in range(m)]


def _logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, steps: int = 400) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on soft targets, by accelerated gradient descent."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 1e-9), 0.5 / max((target <= 0.5).mean(), 1e-9))
    step = 1 / (0.25 * np.linalg.norm(x * np.sqrt(balance)[:, None], 2) ** 2 / len(x) + ridge / len(x))
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ ((p - target) * balance) / len(x) + np.append(ridge / len(x) * v[:-1], 0)
        new = v - step * grad
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def learn(texts: pa.Array, y: np.ndarray) -> Model:
    """The classifier from the texts and labels of the fitting sample."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(STYLES)), -30.0, [])
    if len(set(y.tolist())) < 2:
        return none
    n = len(y)
    once = _distinct_documents(texts)
    # A feature of fewer than three texts of class 1 cannot reach the evidence, whatever the share of the class.
    keys, hits = _counts(texts, once & (y == 1), None)
    support = hits + _counts(texts, once & (y == 0), keys)[1]
    prior = np.clip(y[once].mean(), 0.02, 0.98)
    share = np.clip(hits / np.maximum(support, 1), 1e-9, 1 - 1e-9)
    evidence = support * (share * np.log(share / prior) + (1 - share) * np.log((1 - share) / (1 - prior)))
    good = np.flatnonzero((share > prior) & (evidence > LEAST_EVIDENCE))
    if len(good):
        good = good[_broad(texts.filter(pa.array(once & (y == 1))), keys[good])]
    good = good[np.argsort(-evidence[good], kind="stable")][:MOST_FEATURES]
    column = np.full(len(keys), -1)
    column[good] = np.arange(len(good))
    x, styles = np.zeros((n, len(good)), np.float32), []
    for row, key, some in _pairs(texts):
        styles.append(some)
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        if len(keys):
            at = np.where(keys[at] == key, column[at], -1)
            x[row[at >= 0], at[at >= 0]] = 1
    style = np.concatenate(styles)
    high = np.quantile(style, 0.9, axis=0)
    votes = np.column_stack([np.where(x[:, :MOST_VOTERS] > 0, 1, -1), np.where(style > high + 1e-12, 1, -1), np.where(x.any(axis=1), -1, 0)])
    posterior, voters = label_model(votes[once], y[once])
    w = _logistic(np.column_stack([x[once], style[once]]).astype(float), posterior)
    order = np.argsort(keys[good])
    return Model(keys[good][order], w[: len(good)][order], w[len(good) : -1], float(w[-1]), voters)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, from rows whose crc32 of the id as text modulo 5 is not 0.

    The sample is fitted in one task of an executor: only the model comes to the driver.
    """
    known = labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 != 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picks = [known.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(FIT_ROWS) for v in (0, 1)]
    picks = picks[0].unionByName(picks[1]).toArrow()  # 2 * FIT_ROWS ids at most
    none = learn(pa.array([], pa.string()), np.zeros(0, np.int64))
    if not picks.num_rows:
        return none
    picked = docs.sparkSession.createDataFrame(picks, schema="doc_id long, toxic int")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where((F.octet_length(text) > 0) & (F.octet_length(text) <= FIT_LONGEST)).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = size + np.cumsum(pc.binary_length(batch.column(0).cast(pa.binary())).to_numpy(zero_copy_only=False))
            keep = int(np.searchsorted(ends, FIT_BYTES, side="right"))
            held.append(batch.slice(0, keep))
            if keep < batch.num_rows:
                break
            size = int(ends[-1]) if len(ends) else size
        whole = pa.Table.from_batches(held) if held else pa.table({"text": pa.array([], pa.string()), "toxic": pa.array([], pa.int32())})
        texts = pa.concat_arrays([c.cast(pa.string()) for c in whole["text"].chunks]) if whole.num_rows else pa.array([], pa.string())
        model = pickle.dumps(learn(texts, whole["toxic"].to_numpy().astype(np.int64)))
        del held, whole, texts
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    model = rows.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "toxic").mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(model[0])) if model else none


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores from 0 to 1 of whole texts."""
    out, size = np.zeros(len(texts)), 1 << 20
    keep = np.zeros(size, bool)
    keep[(model.keys & np.uint64(size - 1)).astype(np.int64)] = True
    for first, data, offsets in text_blocks(texts):
        rows, keys, style = features(data, offsets, keep)
        n = len(offsets) - 1
        value = style @ model.styles + model.bias
        if len(model.keys) and len(keys):
            at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
            hit = model.keys[at] == keys
            pairs = np.unique(rows[hit].astype(np.int64) * len(model.keys) + at[hit])
            value = value + np.bincount(pairs // len(model.keys), weights=model.weights[pairs % len(model.keys)], minlength=n)
        out[first : first + n] = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
    return out


def score_column(model: Model, text: Column) -> Column:
    """Score of a text column, by Arrow batches; the other columns stay in the JVM."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(model, texts))

    return score(text.cast("string"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text modulo 5 is 0; false for a null id), score, predicted."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score_column(fit(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns as they are."""
    score = score_column(fit(docs, labels), F.col("text"))
    name = "__toxic" + "_" * max(map(len, docs.columns))
    return docs.withColumn(name, score).where(F.col(name) < 0.5).drop(name)
