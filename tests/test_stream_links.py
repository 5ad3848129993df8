"""Chain checks on streams: logs of a bucket together, over several micro-batches."""

import random

import pandas as pd
from pyspark.sql import functions as F

from plumbline.streaming import monitors, replay


class Handle:
    class Map(dict):
        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    def getMapState(self, *_):
        return self.Map()


def plain(rows, state):
    """link and in_sequence by (log, line), log by log and record by record."""
    out = {}
    for log, line, sequence, digest, previous in sorted(rows, key=lambda r: r[1]):
        last, expected = state.get(log, (None, 0))
        link = ("GENESIS" if previous is None else "ORPHANED") if expected == 0 else "LINKED" if previous is not None and previous == last else "BROKEN"
        out[log, line] = (link, sequence == expected)
        state[log] = (digest, expected + 1)
    return out


def test_links_of_many_logs_over_micro_batches():
    rng, links, state = random.Random(4), monitors.Links(), {}
    links.init(Handle())
    for batch in range(4):
        rows, last = [], {log: s[0] for log, s in state.items()}
        for line in range(1000 * batch, 1000 * batch + 300):
            log, digest = f"l{rng.randint(0, 40)}", f"d{line}"
            rows.append((log, line, rng.choice([0, 1, 2, line // 40]), digest, rng.choice([last.get(log), last.get(log), None, "other"])))
            last[log] = digest
        want = plain(rows, state)
        rng.shuffle(rows)
        parts = [pd.DataFrame(rows[i : i + 128], columns=["log_id", "line", "sequence", "digest", "previous"]) for i in range(0, len(rows), 128)]
        got = pd.concat(links.handleInputRows((0,), iter(parts), None))
        assert {(r.log_id, r.line): (r.link, r.in_sequence) for r in got.itertuples()} == want
    assert {log: v for (log,), v in links.logs.items()} == state


def test_logs_share_groups_of_state(spark, tmp_path):
    spark.range(2000).select(F.col("id").cast("string").alias("log_id"), F.col("id").alias("line"), F.lit(0).cast("long").alias("sequence"), F.lit("d").alias("digest"), F.lit(None).cast("string").alias("previous")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("log_id string, line long, sequence long, digest string, previous string").parquet(f"{tmp_path}/in")
    with replay.map_state(spark):
        query = monitors.verify_stream(source, buckets=4).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r.link, r.in_sequence) for r in spark.read.parquet(f"{tmp_path}/out").distinct().select("link", "in_sequence").collect()} == {("GENESIS", True)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2000
