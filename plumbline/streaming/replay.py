"""Replay detection over streams that never end: what was seen is kept in map state, for as long as a retention says.

A record claims its digest, its nonce under a key, its slot of a log and its subject.  Claims are dealt by hash to buckets; a
bucket is one state group, so a micro-batch calls Python once for each bucket.  Claims (128 bits of their SHA-256) and the
records that made them last stand in slots, entries of map state that hold some hundred claims each; a micro-batch reads
and writes the slots that its claims fall into, each once, and slots double as claims grow.  With a retention a claim
counts that long (processing time) after its last use; a bucket that gets rows drops what is older once a retention.
An answer of "not seen before" then holds only within the retention.

A micro-batch's rows of one bucket are in memory together: bound them by the source's rate (maxFilesPerTrigger and the like)
and the number of buckets.  Null parts make no claim; rows of one `seen` are answered in any order.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of claims in order of precedence, with what makes them; a subject seen again is no replay.
KINDS = {"REPLAY_EXACT": ("digest",), "NONCE_REUSE": ("key_id", "nonce"), "SEQUENCE_COLLISION": ("log_id", "sequence"), "DUPLICATE_SUBJECT": ("subject",)}
ANSWERS = "seen long, kind string, prior long"
BUCKETS = 256
#: Claims of a slot, about, and what is kept of one: its mark, the record that made it last, the time of that (ms).
SLOT_CLAIMS = 256
CLAIM = np.dtype([("high", "<u8"), ("low", "<u8"), ("seen", "<i8"), ("used", "<i8")])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that start keep their state in RocksDB, which map state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Memory(StatefulProcessor):
    """The last record of each claim of a bucket, in slots of about SLOT_CLAIMS claims."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "claims binary")
        self.shape = handle.getValueState("shape", "slots int, claims long, swept long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = time.time_ns() // 1_000_000
        shown = pd.concat(list(rows), ignore_index=True)
        marks = np.frombuffer(b"".join(shown["mark"]), "<u8").reshape(-1, 2)
        order = np.lexsort((shown["seen"], marks[:, 1], marks[:, 0]))
        shown, marks = shown.iloc[order].reset_index(drop=True), marks[order]
        again = np.concatenate([[False], (marks[1:] == marks[:-1]).all(axis=1)])
        seen = shown["seen"].to_numpy()
        prior, known = np.where(again, np.roll(seen, 1), 0), again.copy()
        tails = np.append(~again[1:], True)
        mine = np.zeros(int(tails.sum()), CLAIM)
        mine["high"], mine["low"], mine["seen"], mine["used"] = marks[tails, 0], marks[tails, 1], seen[tails], now
        slots, claims, swept = self.shape.get() or (1, 0, now)
        if self.keep_ms is not None and now - swept >= self.keep_ms:
            claims, swept = self.sweep(now), now
        slots = self.widen(slots, claims + len(mine))
        held = self.read(np.unique(mine["low"] & np.uint64(slots - 1)).tolist())
        both = np.concatenate([held, mine])
        from_mine = np.arange(len(both)) >= len(held)
        order = np.lexsort((from_mine, both["low"], both["high"]))
        both, from_mine = both[order], from_mine[order]
        met = np.append((both["high"][1:] == both["high"][:-1]) & (both["low"][1:] == both["low"][:-1]), False)  # an old one, with its new one next
        # The heads of this batch's claims stand in the order of marks, as the new ones do here.
        heads = np.flatnonzero(~again)
        old = np.flatnonzero(met)
        place = (np.cumsum(from_mine) - 1)[old + 1]
        lives = np.array([self.lives(used, now) for used in both["used"][old].tolist()], bool)
        prior[heads[place[lives]]], known[heads[place[lives]]] = both["seen"][old[lives]], True
        self.write(both[~met], slots)
        self.shape.update((slots, int(claims + (~met).sum() - len(held)), swept))
        yield pd.DataFrame({"seen": seen, "kind": shown["kind"], "prior": pd.array(prior, dtype="Int64")}).assign(prior=lambda d: d["prior"].where(known))

    def read(self, slots: list[int]) -> np.ndarray:
        found = [self.slots.getValue((slot,)) for slot in slots]
        return np.concatenate([np.zeros(0, CLAIM), *(np.frombuffer(f[0], CLAIM) for f in found if f is not None)])

    def write(self, claims: np.ndarray, slots: int) -> None:
        """Replaces the slots of these claims by them."""
        slot = claims["low"] & np.uint64(slots - 1)
        order = np.argsort(slot, kind="stable")
        edges = np.flatnonzero(np.diff(slot[order])) + 1
        for part in np.split(claims[order], edges):
            if len(part):
                self.slots.updateValue((int(part["low"][0]) & (slots - 1),), (part.tobytes(),))

    def widen(self, slots: int, claims: int) -> int:
        """So many slots (a power of two) that they hold about SLOT_CLAIMS claims; when they double, all are dealt anew."""
        wanted = slots
        while wanted * SLOT_CLAIMS < claims:
            wanted *= 2
        if wanted > slots:
            whole = [np.zeros(0, CLAIM), *(np.frombuffer(v[0], CLAIM) for _, v in self.slots.iterator())]
            self.write(np.concatenate(whole), wanted)  # each old slot keeps its number for a part of its claims, or is dropped
            kept = {int(s) for s in np.unique(np.concatenate(whole)["low"] & np.uint64(wanted - 1))}
            for slot in [k[0] for k in self.slots.keys() if k[0] not in kept]:
                self.slots.removeKey((slot,))
        return wanted

    def sweep(self, now: int) -> int:
        """Drops the claims that are older than the retention, and counts the others."""
        count = 0
        for slot, value in list(self.slots.iterator()):
            claims = np.frombuffer(value[0], CLAIM)
            kept = claims[[self.lives(used, now) for used in claims["used"].tolist()]]
            count += len(kept)
            if not len(kept):
                self.slots.removeKey((slot[0],))
            elif len(kept) < len(claims):
                self.slots.updateValue((slot[0],), (kept.tobytes(),))
        return count

    def lives(self, used: int, now: int) -> bool:
        return self.keep_ms is None or now - used < self.keep_ms

    def close(self) -> None:
        pass


def claims_of(records: DataFrame) -> DataFrame:
    """records (seen, digest, key_id, nonce, log_id, sequence and, where there is one, subject) -> a row (kind, claim, seen) for each
    thing that a record may be the only one to have."""

    def sure(kind: str, parts: tuple[str, ...]):
        known = reduce(lambda a, b: a & b, (F.col(p).isNotNull() for p in parts))
        return F.when(known, F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(*parts)).alias("claim")))

    kinds = F.array(*(sure(kind, parts) for kind, parts in KINDS.items() if set(parts) <= set(records.columns)))
    return records.select("seen", F.explode(F.array_compact(kinds)).alias("c")).select("seen", "c.kind", "c.claim")


def replay_stream(records: DataFrame, keep_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of records -> for each of its claims (seen, kind), the last record before it that made the same one (prior), or null.

    It is to be started within map_state().  The number of buckets belongs to the checkpoint: a restart keeps it.
    """
    bucket = F.pmod(F.xxhash64("kind", "claim"), F.lit(buckets)).cast("int").alias("bucket")
    mark = F.unhex(F.substring(F.sha2(F.concat_ws(":", "kind", "claim").cast("binary"), 256), 1, 32)).alias("mark")
    claims = claims_of(records).select(bucket, "seen", "kind", mark)
    return claims.groupBy("bucket").transformWithStateInPandas(Memory(keep_ms), ANSWERS, "Append", "None")


def replay_answers(claims: DataFrame) -> DataFrame:
    """What replay_stream() has written -> seen, verdict, prior: the first kind of claim that was made before decides."""
    priors = [F.max(F.when(F.col("kind") == k, F.col("prior"))).alias(k) for k in KINDS]
    verdict = F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in KINDS), F.lit("FIRST_OBSERVATION"))
    return claims.groupBy("seen").agg(*priors).select("seen", verdict.alias("verdict"), F.coalesce(*KINDS).alias("prior"))
