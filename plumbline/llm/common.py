"""What the training-data operators share: shared-folder tables and hashing of words in byte buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised scanners work on at a time (a longer document is worked on whole).
BLOCK_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a local session that names none, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow string array in blocks: first row, bytes, offsets (rows + 1, from 0); null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=width, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (SplitMix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a byte buffer without a Python loop over words.

    The hash of a byte range is polynomial modulo 2**64 over random byte values; prefix sums and the inverse of the odd
    base give the hash of any range in constant time.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, separators: bytes, lower: bool = True, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.inverse = np.uint64(pow(self.BASE, -1, 1 << 64))
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            size = len(self.powers)
            step, back = (np.uint64(pow(x, size, 1 << 64)) for x in (self.BASE, int(self.inverse)))
            self.powers = np.concatenate([self.powers, self.powers * step])
            self.inverses = np.concatenate([self.inverses, self.inverses * back])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts and ends of words, the row of each, and the prefix sums for range()."""
        n = len(data)
        self._grow(n + 1)
        inside = np.zeros(n + 2, bool)
        np.logical_not(self.separator[data], out=inside[1:-1])
        edge_in, edge_out = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        edge_in[cut] = inside[1:-1][cut]
        edge_out[cut - 1] = inside[1:-1][cut - 1]
        starts, ends = np.flatnonzero(edge_in), np.flatnonzero(edge_out) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        rows = np.searchsorted(offsets, starts, side="right") - 1
        return starts, ends, rows, sums

    def range(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the byte ranges."""
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
