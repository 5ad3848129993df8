"""Replay memory and window drift on streams, against plain Python."""

import datetime
import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.streaming import replay, windows

RECORD = "seen long, digest string, key_id string, nonce string, log_id string, sequence long, subject string"


def run(stream, folder):
    with replay.map_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def show(spark, rows, folder):
    spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def answers(spark, folder, keep_ms=None):
    source = spark.readStream.schema(RECORD).parquet(f"{folder}/in")
    out = run(replay.replay_stream(source, keep_ms, buckets=4), folder)
    return {r.seen: (r.verdict, r.prior) for r in replay.replay_answers(out).collect()}


def test_replay_remembers_over_restarts(spark, tmp_path):
    show(spark, [(1, "d1", "k", "n1", "l", 1, "s1"), (2, "d1", "k", "n1", "l", 1, "s1"), (3, "d3", "k", "n1", "l", 3, None), (4, "d4", None, None, None, None, None)], tmp_path)
    first = answers(spark, tmp_path)
    assert first == {1: ("FIRST_OBSERVATION", None), 2: ("REPLAY_EXACT", 1), 3: ("NONCE_REUSE", 2), 4: ("FIRST_OBSERVATION", None)}
    show(spark, [(5, "d5", "k", "n5", "l", 3, "s5"), (6, "d6", None, "n6", None, 6, "s5"), (7, "d4", None, None, None, None, None), (8, "d8", "j", "n1", "m", 1, None)], tmp_path)
    later = answers(spark, tmp_path)
    assert later == {**first, 5: ("SEQUENCE_COLLISION", 3), 6: ("DUPLICATE_SUBJECT", 5), 7: ("REPLAY_EXACT", 4), 8: ("FIRST_OBSERVATION", None)}


def test_replay_forgets_after_its_retention(spark, tmp_path):
    one = [(1, "d", None, None, None, None, None)]
    show(spark, one, tmp_path)
    answers(spark, tmp_path, keep_ms=1500)
    time.sleep(2.5)
    show(spark, [(2, "d", None, None, None, None, None), (3, "d", None, None, None, None, None)], tmp_path)
    later = answers(spark, tmp_path, keep_ms=1500)
    assert later[2] == ("FIRST_OBSERVATION", None) and later[3] == ("REPLAY_EXACT", 2)


def test_replay_of_many_copies_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"d{rng.randint(0, 40) if i % 3 else 0}", None, None, None, None, None) for i in range(600)]
    want, last = {}, {}
    for seen, digest, *_ in rows:
        want[seen] = ("REPLAY_EXACT", last[digest]) if digest in last else ("FIRST_OBSERVATION", None)
        last[digest] = seen
    rng.shuffle(rows)
    show(spark, rows, tmp_path)
    assert answers(spark, tmp_path) == want


DAY = datetime.datetime(2024, 3, 1)


def psi_of(reference, current, bins=10):
    """Edges are interpolated quantiles; bins are closed above."""
    ordered = sorted(reference)
    edges = []
    for i in range(1, bins):
        at = (len(ordered) - 1) * i / bins
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        edges.append(low + (high - low) * (at - math.floor(at)))
    edges = sorted(set(edges))
    shares = []
    for values in (reference, current):
        counts = [0] * (len(edges) + 1)
        for v in values:
            counts[sum(e < v for e in edges)] += 1
        shares.append([max(c / len(values), 1 / (2 * len(values))) for c in counts])
    return sum((q - p) * math.log(q / p) for p, q in zip(*shares, strict=True))


@pytest.fixture(scope="module")
def moved(spark, tmp_path_factory):
    """Four days, of which each lies 0.3 higher than the one before, a last moment that closes them, and what is no value."""
    rng = random.Random(8)
    days = {d: [rng.gauss(0.3 * d, 1) for _ in range(3000)] for d in range(4)}
    rows = [(DAY + datetime.timedelta(days=d, seconds=20 * i), v, float(i % 3)) for d, values in days.items() for i, v in enumerate(values)]
    rows += [(DAY, None, None), (DAY, float("nan"), 1.0), (DAY + datetime.timedelta(days=9), 0.0, 0.0)]
    folder = str(tmp_path_factory.mktemp("values"))
    spark.createDataFrame(rows, "ts timestamp, value double, level double").write.mode("overwrite").parquet(folder)
    return days, folder


def streamed(spark, folder):
    return spark.readStream.schema("ts timestamp, value double, level double").parquet(folder)


def first_day(spark, folder):
    return spark.read.parquet(folder).where(F.col("ts") < F.lit(DAY + datetime.timedelta(days=1)))


def test_bins_of_windows_are_exact(spark, moved, tmp_path):
    days, folder = moved
    reference = windows.reference_bins(first_day(spark, folder), "value").cache()
    out = run(windows.window_bins(streamed(spark, folder), reference, "value"), str(tmp_path))
    got = {r.start: r for r in windows.bin_drift(out, reference).collect()}
    for d, values in days.items():
        row = got[DAY + datetime.timedelta(days=d)]
        assert row.n == 3000 and row.psi == pytest.approx(psi_of(days[0], values), abs=1e-8)
    assert [got[DAY + datetime.timedelta(days=d)].band for d in range(4)] == ["stable", "stable", "major", "major"]
    assert got[DAY].js == 0 and len(got) == 4


def test_sketches_are_near_and_merge(spark, moved, tmp_path):
    days, folder = moved
    names = ["value", "level"]
    reference = windows.reference_sketch(first_day(spark, folder), names).cache()
    out = run(windows.window_sketches(streamed(spark, folder), names), str(tmp_path)).cache()
    got = {(r.column, r.start): r for r in windows.sketch_drift(out, reference, names).collect()}
    assert len(got) == 8
    for d, values in days.items():
        row = got["value", DAY + datetime.timedelta(days=d)]
        assert row.n == 3000 and row.psi == pytest.approx(psi_of(days[0], values), abs=0.05)
        assert got["level", DAY + datetime.timedelta(days=d)].psi == pytest.approx(0, abs=0.01)
    pairs = windows.merged_windows(out, names, "2 days")
    for r in windows.sketch_drift(pairs, reference, ["value"]).collect():
        d = (r.start - DAY).days
        both = [v for x in (d, d + 1) for v in days.get(x, [])]
        assert r.n == len(both) and r.psi == pytest.approx(psi_of(days[0], both), abs=0.05)


def test_windows_without_values(spark, moved):
    _, folder = moved
    rows = first_day(spark, folder)
    empty = windows.reference_sketch(rows.where("false"), ["value"])
    some = rows.groupBy(F.window("ts", "1 day").alias("w")).agg(*windows._sketches(["value"], 200))
    assert windows.sketch_drift(some, empty, ["value"]).count() == 0
    hollow = rows.withColumn("value", F.lit(None).cast("double")).groupBy(F.window("ts", "1 day").alias("w")).agg(*windows._sketches(["value"], 200))
    assert windows.sketch_drift(hollow, windows.reference_sketch(rows, ["value"]), ["value"]).count() == 0
    one = windows.reference_sketch(spark.createDataFrame([(2.0,)] * 9, "value double"), ["value"])
    inside = some.select(F.kll_sketch_get_rank_double("value", F.lit(2.0))).first()[0]
    want = (inside - 1) * math.log(inside) + (1 - inside - 1 / 18) * math.log((1 - inside) * 18)  # one distinct value is one edge
    assert windows.sketch_drift(some, one, ["value"]).first().psi == pytest.approx(want, abs=1e-8)


def test_replay_touches_slots_not_claims_and_widens_them(spark, tmp_path, monkeypatch):
    class Map(dict):
        calls = 0

        def getValue(self, key):
            Map.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            Map.calls += 1
            self[key] = value

        def iterator(self):
            return iter(list(self.items()))

        def removeKey(self, key):
            del self[key]

    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

    memory, rng, last, size = replay.Memory(), random.Random(9), {}, 0
    memory.init(Handle())
    for batch in range(6):
        rows = [(1_000_000 * batch + i, "REPLAY_EXACT", rng.randint(0, 60_000).to_bytes(2, "little") * 8) for i in range(20_000)]
        want = {}
        for seen, _, mark in rows:
            want[seen] = last.get(mark)
            last[mark] = seen
        rng.shuffle(rows)
        Map.calls = 0
        parts = [pd.DataFrame(rows[i : i + 7000], columns=["seen", "kind", "mark"]) for i in range(0, len(rows), 7000)]
        got = pd.concat(memory.handleInputRows((0,), iter(parts), None))
        assert {r.seen: None if pd.isna(r.prior) else r.prior for r in got.itertuples()} == want
        assert Map.calls < 2000
        assert memory.shape.get()[1] == len(last) == sum(len(v[0]) // replay.CLAIM.itemsize for _, v in memory.slots.iterator())
    assert memory.shape.get()[0] > 64
