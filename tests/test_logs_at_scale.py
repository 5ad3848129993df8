"""Logs over many splits and segments: lines keep their numbers, chains their answers."""

import json
import random

from pyspark.sql import functions as F

from plumbline.operators import provenance
from plumbline.sources import logs

KIND = "log_id string, line long, sequence long, digest string, previous string, extra string"


def plain_links(rows):
    """(log_id, line) -> position, link, in_sequence by walking each log."""
    out, held = {}, {}
    for log, line, sequence, digest, previous, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        position, before = held.get(log, (0, None))
        if position == 0:
            link = "GENESIS" if previous is None else "ORPHANED"
        else:
            link = "LINKED" if previous is not None and previous == before else "BROKEN"
        out[log, line] = (position, link, sequence == position)
        held[log] = position + 1, digest
    return out


def chain(log, n, rng, faults):
    rows, before = [], None
    for k in range(n):
        digest = f"{log}-{k}-{rng.random()}"
        rows.append([log, 10 * k, k, digest, before, "x"])
        before = digest
    for k in faults:
        kind = rng.choice(["previous", "none", "sequence", "digest"])
        if kind == "sequence":
            rows[k][2] = rng.choice([None, k + 1])
        elif kind == "digest":
            rows[k][3] = "edited"
        else:
            rows[k][4] = None if kind == "none" else "elsewhere"
    return [tuple(r) for r in rows]


def test_one_long_log_is_many_segments(spark):
    rng = random.Random(1)
    rows = chain("long", 4000, rng, rng.sample(range(4000), 40)) + [r for k in range(30) for r in chain(f"log{k}", rng.randint(1, 6), rng, [0] if k % 3 == 0 else [])] + chain(None, 5, rng, [])
    rows = [r for r in rows if not (r[0] == "long" and r[2] == 1777)]
    rng.shuffle(rows)
    got = provenance.chain_links(spark.createDataFrame(rows, KIND))
    assert {(r.log_id, r.line): (r.position, r.link, r.in_sequence) for r in got.collect()} == plain_links(rows)
    assert got.columns == ["log_id", "line", "sequence", "digest", "previous", "extra", "position", "link", "in_sequence"]
    dealt = spark.createDataFrame(rows, KIND).repartitionByRange(4, "log_id", "line").withColumn("p", F.spark_partition_id()).where("log_id = 'long'").groupBy("p").count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 2000


def test_an_empty_log_has_no_links(spark):
    assert not provenance.chain_links(spark.createDataFrame([], KIND)).collect()


def entry(k):
    return json.dumps({"record": {"schema_version": "1.0", "sequence": {"log_id": "l", "sequence_number": k}, "nonce": "n" * (k % 300)}, "signature": {"key_id": "k"}})


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice([entry(k), entry(k), entry(k), "", "   ", "not json", '{"other": 1}', '{"record": 5}']) for k in range(900)]
        (tmp_path / name).write_bytes(("\r\n" if name == "b.jsonl" else "\n").join(lines).encode())
        want |= {(name, k + 1): line for k, line in enumerate(lines) if line.strip()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        entries, bad = logs.read_log(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[1], r.line): r.raw for r in entries.collect()}
        wrong = {(r.file.rsplit("/", 1)[1], r.line): r.raw for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {**got, **wrong} == want and not set(got) & set(wrong)
    assert all(v.startswith('{"record": {') for v in got.values()) and all(not v.startswith('{"record": {') for v in wrong.values())


def test_batches_of_a_stream_are_numbered(spark, tmp_path):
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(entry(i) for i in range(5)))
    seen = []

    def keep(batch, _):
        entries, _ = logs.parsed_lines(logs.numbered_lines(batch))
        seen.extend((r.file.rsplit("/", 1)[1], r.line, r.record.sequence.sequence_number) for r in entries.collect())

    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).select("value", "_metadata")
    lines.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [(f"{k}.jsonl", i + 1, i) for k in range(2) for i in range(5)]
