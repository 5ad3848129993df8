"""Stored models as tables: layers, values and tensor extents of ONNX files, then blocks of tensor values, without a runtime.

A first job reads only the structure of each file: fields that hold tensor data are passed over by their length, so a task
holds one buffer, whatever the size of the file.  A second job reads the data in blocks of BLOCK values, each by its own range of
bytes, in as many tasks as there are blocks.  Digests of the file, the graph and the parameters come from these rows: a file
that was written again by another program keeps its graph and parameter digests, a file of other weights keeps its graph
digest, and the graph digest holds no weights.

What cannot be read is a row of kind `unreadable` with its reason, never an error of the job.  Files are opened through
Arrow's file systems; a store that these do not know makes its files unreadable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.findings import sha256

#: Values of a block, bytes that are read at a time, and the longest name or attribute that is taken.
BLOCK, CHUNK, LONGEST_NAME = 65_536, 1 << 16, 1 << 20

# Element types of the format, with the size of a value in raw data.
ELEMENTS = {
    1: ("float32", "<f4"), 2: ("uint8", "<u1"), 3: ("int8", "<i1"), 4: ("uint16", "<u2"), 5: ("int16", "<i2"), 6: ("int32", "<i4"), 7: ("int64", "<i8"), 8: ("string", None), 9: ("bool", "<u1"), 10: ("float16", "<f2"), 11: ("float64", "<f8"),
    12: ("uint32", "<u4"), 13: ("uint64", "<u8"), 16: ("bfloat16", "<u2"),
}
_DTYPES = dict(ELEMENTS.values())
# Fields of typed tensor data -> bytes of a value, or varints.
_TYPED = {4: 4, 5: None, 7: None, 10: 8, 11: None}

PART = (
    "model string, kind string, position int, name string, op_type string, inputs array<string>, outputs array<string>, dtype string, shape array<long>, "
    "location string, start long, length long, encoding string, reason string"
)
_LISTS = {"inputs": pa.list_(pa.string()), "outputs": pa.list_(pa.string()), "shape": pa.list_(pa.int64())}
_NUMBERS = {"position": pa.int32(), "start": pa.int64(), "length": pa.int64()}
_COLUMNS = [c.split()[0] for c in PART.split(", ")]
_SCHEMA = pa.schema([(c, _LISTS.get(c) or _NUMBERS.get(c) or pa.string()) for c in _COLUMNS])


class Unreadable(ValueError):
    """The bytes are no such model."""


class Wire:
    """Fields of a protocol-buffer file, read through one buffer; values of fields with a length are their places."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.buffer = file, file.size(), 0, b""

    def take(self, start: int, n: int) -> bytes:
        """n bytes from start."""
        if start < self.base or start + n > self.base + len(self.buffer):
            self.file.seek(start)
            self.base, self.buffer = start, self.file.read(max(n, CHUNK))
        out = self.buffer[start - self.base : start - self.base + n]
        if len(out) < n:
            raise Unreadable("the file ends inside a field")
        return out

    def varint(self, at: int, end: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            if at >= end or shift > 63:
                raise Unreadable("a number has no end")
            byte = self.take(at, 1)[0]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value & (1 << 64) - 1, at

    def fields(self, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(field, wire type, value or first byte, length) of a message."""
        while at < end:
            tag, at = self.varint(at, end)
            number, kind = tag >> 3, tag & 7
            if kind == 0:
                value, at = self.varint(at, end)
                yield number, kind, value, 0
                continue
            if kind == 2:
                n, at = self.varint(at, end)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise Unreadable(f"a field of wire type {kind}")
            if not number or at + n > end:
                raise Unreadable("a field is longer than its message")
            yield number, kind, at, n
            at += n

    def text(self, start: int, n: int) -> str:
        if n > LONGEST_NAME:
            raise Unreadable("a name of more than a million bytes")
        try:
            return self.take(start, n).decode()
        except UnicodeDecodeError as e:
            raise Unreadable("a name is no text") from e


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tensor(wire: Wire, start: int, n: int) -> dict:
    """Name, type, shape and place of a tensor's data."""
    out: dict = {"shape": [], "name": "", "dtype": None, "location": None, "start": 0, "length": 0, "encoding": "raw"}
    external: dict[str, str] = {}
    for number, kind, at, size in wire.fields(start, start + n):
        if number == 1 and kind == 0:
            out["shape"].append(signed(at))
        elif number == 1 and kind == 2:
            end = at + size
            while at < end:
                value, at = wire.varint(at, end)
                out["shape"].append(signed(value))
        elif number == 2 and kind == 0:
            if at not in ELEMENTS:
                raise Unreadable(f"an element type {at}")
            out["dtype"] = ELEMENTS[at][0]
        elif number == 8:
            out["name"] = wire.text(at, size)
        elif number == 9:
            out |= {"start": at, "length": size, "encoding": "raw"}
        elif number in _TYPED:
            if kind != 2:
                raise Unreadable("values that are not packed")
            if out["length"] and size:
                raise Unreadable("values in several parts")
            out |= {"start": at, "length": size, "encoding": "raw" if _TYPED[number] else "varint"}
        elif number == 13:
            pair = {k: wire.text(a, s) for k, _, a, s in wire.fields(at, at + size)}
            external[pair.get(1, "")] = pair.get(2, "")
    if external:
        out |= {"location": external.get("location"), "start": int(external.get("offset", 0)), "length": int(external.get("length", -1)), "encoding": "raw"}
    if out["dtype"] == "float16" and out["encoding"] == "varint":
        out["encoding"] = "halves"
    return out


def _value(wire: Wire, start: int, n: int) -> dict:
    """Name, type and shape (-1: open) of an input, output or inner value."""
    out: dict = {"name": "", "dtype": None, "shape": None}
    for number, _, at, size in wire.fields(start, start + n):
        if number == 1:
            out["name"] = wire.text(at, size)
        elif number == 2:
            for kind, _, a, s in wire.fields(at, at + size):
                if kind != 1:  # no tensor
                    continue
                for part, _, b, t in wire.fields(a, a + s):
                    if part == 1:
                        out["dtype"] = ELEMENTS.get(b, (f"elem{b}",))[0]
                    elif part == 2:
                        sizes = []
                        for _, _, c, u in wire.fields(b, b + t):
                            known = [v for k, w, v, _ in wire.fields(c, c + u) if k == 1 and w == 0]
                            sizes.append(signed(known[-1]) if known else -1)
                        out["shape"] = sizes
    return out


def _node(wire: Wire, start: int, n: int) -> dict:
    out: dict = {"inputs": [], "outputs": [], "name": "", "op_type": ""}
    for number, _, at, size in wire.fields(start, start + n):
        if number in (1, 2):
            out["inputs" if number == 1 else "outputs"].append(wire.text(at, size))
        elif number in (3, 4):
            out["name" if number == 3 else "op_type"] = wire.text(at, size)
    return out


def _structure(wire: Wire) -> Iterator[dict]:
    """Rows of PART of one file: layers in order, tensors, values, and what it says about itself."""
    layers = graphs = 0
    for number, kind, at, size in wire.fields(0, wire.size):
        if number == 1 and kind == 0:
            yield {"kind": "declared", "name": "ir_version", "reason": str(at)}
        elif number in (2, 3, 6) and kind == 2 and size:
            yield {"kind": "declared", "name": {2: "producer_name", 3: "producer_version", 6: "doc_string"}[number], "reason": wire.text(at, size)}
        elif number == 8 and kind == 2:
            pair = {k: (wire.text(a, s) if w == 2 else a) for k, w, a, s in wire.fields(at, at + size)}
            yield {"kind": "declared", "name": f"opset.{pair.get(1) or 'ai.onnx'}", "reason": str(pair.get(2, ""))}
        elif number == 14 and kind == 2:
            pair = {k: wire.text(a, s) for k, _, a, s in wire.fields(at, at + size)}
            yield {"kind": "declared", "name": f"meta.{pair.get(1, '')}", "reason": pair.get(2, "")}
        elif number == 7 and kind == 2:  # parts of one message may come apart
            graphs += 1
            for part, _, a, s in wire.fields(at, at + size):
                if part == 1:
                    node = _node(wire, a, s)
                    yield {"kind": "layer", "position": layers, **node, "name": node["name"] or f"{node['op_type']}_{layers}"}
                    layers += 1
                elif part == 5:
                    yield {"kind": "tensor", **_tensor(wire, a, s)}
                elif part in (11, 12, 13):
                    yield {"kind": {11: "input", 12: "output", 13: "inner"}[part], **_value(wire, a, s)}
                elif part == 15:
                    raise Unreadable("sparse tensors")
    if not graphs:
        raise Unreadable("no graph")


def _open(path: str) -> pa.NativeFile:
    uri = path if "://" in path else path.replace("file:/", "file:///", 1)
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """model (path of the file), size, of the ONNX files under a path; their content is not read, and empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.onnx").load(path)
    return files.select(F.col("path").alias("model"), F.col("length").alias("size"))


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "model")


def read_structure(files: DataFrame) -> DataFrame:
    """PART rows of files (model); an unreadable file is one row of that kind and no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{c: r.get(c) for c in _COLUMNS} for r in rows], schema=_SCHEMA)

        for models in batches:
            for model in models.column(0).to_pylist():
                try:
                    with _open(model) as file:
                        for row in _structure(Wire(file)):  # once without keeping anything: a fault leaves no half model
                            pass
                        rows = []
                        for row in _structure(Wire(file)):
                            rows.append({"model": model, **row})
                            if len(rows) == 1000:
                                yield batch(rows)
                                rows = []
                        yield batch(rows)
                except (Unreadable, OSError, pa.ArrowException) as e:
                    yield batch([{"model": model, "kind": "unreadable", "reason": str(e)[:500]}])

    return _spread(files.select("model")).mapInArrow(run, PART)


def file_digests(files: DataFrame) -> DataFrame:
    """model, file (sha256 of its bytes, read in chunks; null if it cannot be read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for models in batches:
            names, out = models.column(0).to_pylist(), []
            for model in names:
                sha = hashlib.sha256()
                try:
                    with _open(model) as file:
                        while chunk := file.read(1 << 20):
                            sha.update(chunk)
                    out.append(sha.hexdigest())
                except (OSError, pa.ArrowException):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["model", "file"])

    return _spread(files.select("model")).mapInArrow(run, "model string, file string")


def _varints(data: np.ndarray) -> np.ndarray:
    """The numbers of a stretch of whole varints."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def _values(data: bytes, dtype: str, encoding: str) -> np.ndarray:
    """Values of a block of raw data, or of numbers that were varints."""
    if encoding == "raw":
        x = np.frombuffer(data, _DTYPES[dtype])
        return (x.astype(np.uint32) << 16).view(np.float32) if dtype == "bfloat16" else x
    whole = _varints(np.frombuffer(data, np.uint8))
    if dtype == "float16":
        return whole.astype(np.uint16).view(np.float16)
    if dtype == "bfloat16":
        return (whole.astype(np.uint32) << 16).view(np.float32)
    return whole if dtype in ("uint32", "uint64") else whole.view(np.int64)


def _units(values: np.ndarray) -> np.ndarray:
    """Whole millionths of floating-point values, one mark for what is not finite; other values as they are."""
    if values.dtype.kind != "f":
        return values.astype(np.int64)
    x = values.astype(np.float64)
    finite = np.isfinite(x)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.rint(np.where(finite, x, 0) * 1e6)
        whole = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    return np.where(finite, whole, np.iinfo(np.int64).min)


BLOCKS = "model string, name string, dtype string, shape array<long>, block long, values array<double>, units array<long>, reason string"


def tensor_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of BLOCK values of all tensors of read_structure(): values as numbers and in whole millionths.

    Blocks are read by their ranges of bytes, spread over all tasks; the data of a tensor in varints are read by one task, a
    stretch at a time.  A tensor whose data do not fit its shape is a row with a reason.
    """
    tensors = parts.where("kind = 'tensor' AND dtype IS NOT NULL AND dtype <> 'string'")
    width = F.element_at(F.create_map(*(F.lit(v) for k, d in _DTYPES.items() if d for v in (k, int(d[2:])))), F.col("dtype"))
    count = F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b)
    one = F.col("encoding") != "raw"
    rows = tensors.select("model", "name", "dtype", "shape", "location", "start", "length", "encoding", width.alias("width"), count.alias("count"))
    blocks = F.when(one | (F.col("count") <= BLOCK), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / BLOCK)))
    rows = rows.withColumn("block", F.explode(blocks)).repartition("model", "name", "block")

    def stretch(file: pa.NativeFile, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        if row["encoding"] == "raw":
            low = row["block"] * BLOCK
            n = min(BLOCK, row["count"] - low)
            file.seek(row["start"] + low * row["width"])
            yield row["block"], _values(file.read(n * row["width"]), row["dtype"], "raw")
            return
        file.seek(row["start"])
        left, rest, block, held = row["length"], b"", 0, np.zeros(0, np.int64)
        while left:
            data = rest + file.read(min(CHUNK, left))
            left -= len(data) - len(rest)
            end = max(len(data) - 10, 0) if left else len(data)
            while end < len(data) and end and data[end - 1] > 127:
                end += 1
            rest = data[end:]
            part = _values(data[:end], row["dtype"], "varint")
            held = np.concatenate([held, part]) if len(held) else part
            while len(held) >= BLOCK:
                yield block, held[:BLOCK]
                held, block = held[BLOCK:], block + 1
        if len(held) or not block:
            yield block, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string()]

        def out(row: dict, block: int, values: np.ndarray | None, reason: str | None) -> pa.RecordBatch:
            some = [row["model"], row["name"], row["dtype"], row["shape"], block, None if values is None else values.astype(np.float64), None if values is None else _units(values), reason]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(some, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                whole = row["count"] * row["width"]
                if row["encoding"] == "raw" and row["length"] not in (whole, -1):
                    if row["block"] == 0:
                        yield out(row, 0, None, f"{row['length']} bytes of data for {row['count']} values")
                    continue
                try:
                    path = row["model"] if row["location"] is None else row["model"].rsplit("/", 1)[0] + "/" + row["location"]
                    if row["location"] is not None and ".." in row["location"].split("/"):
                        raise Unreadable("data outside of the model's folder")
                    seen = 0
                    with _open(path) as file:
                        for block, values in stretch(file, row):
                            seen += len(values)
                            yield out(row, block, values, None)
                    if row["encoding"] != "raw" and seen != row["count"]:
                        yield out(row, -1, None, f"{seen} values for a shape of {row['count']}")
                except (Unreadable, OSError, ValueError, pa.ArrowException) as e:
                    yield out(row, row["block"], None, str(e)[:500])

    return rows.mapInArrow(run, BLOCKS)


def tensor_digests(blocks: DataFrame) -> DataFrame:
    """model, name, dtype, shape, count, digest (null if a block has a reason) of tensors, from digests of their blocks in order."""
    own = blocks.select("model", "name", "dtype", "shape", "block", "reason", F.size("units").alias("n"), sha256(F.concat_ws(",", F.col("units").cast("array<string>"))).alias("sha"))
    whole = own.groupBy("model", "name", "dtype", "shape").agg(F.sum("n").alias("count"), F.count("reason").alias("faults"), F.array_sort(F.collect_list(F.struct("block", "sha"))).alias("shas"))
    head = F.concat_ws("|", "dtype", F.concat_ws("x", F.col("shape").cast("array<string>")), F.concat_ws(",", "shas.sha"))
    return whole.select("model", "name", "dtype", "shape", F.when(F.col("faults") == 0, F.col("count")).alias("count"), F.when(F.col("faults") == 0, sha256(head)).alias("digest"))


def _lines(rows: DataFrame, order: str, line: F.Column) -> DataFrame:
    """model, lines: sha256 of the lines of each model in order, by the sha256 of each."""
    return rows.select("model", F.col(order).alias("at"), sha256(line).alias("sha")).groupBy("model").agg(sha256(F.concat_ws(",", F.expr("transform(array_sort(collect_list(struct(at, sha))), x -> x.sha)"))).alias("lines"))


def _list(c: str) -> F.Column:
    return F.concat_ws(",", F.col(c).cast("array<string>"))


def model_layers(parts: DataFrame) -> DataFrame:
    """model, position, name, op_type, inputs (without tensors), outputs, output_shape, parameters (their count), dtypes of layers."""
    layers = parts.where("kind = 'layer'").select("model", "position", "name", "op_type", "inputs", "outputs")
    tensors = parts.where("kind = 'tensor'").select("model", F.col("name").alias("input"), "dtype", F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b).alias("count"))
    named = layers.select("model", "position", F.posexplode("inputs").alias("at", "input")).join(tensors, ["model", "input"], "left")
    facts = named.groupBy("model", "position").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("parameters"), F.array_sort(F.collect_set("dtype")).alias("dtypes"),
        F.expr("transform(array_sort(collect_list(CASE WHEN count IS NULL THEN struct(at, input) END)), x -> x.input)").alias("inputs"),
    )
    shapes = parts.where("kind IN ('inner', 'output')").groupBy("model", F.col("name").alias("output")).agg(F.first("shape", True).alias("output_shape"))
    out = layers.drop("inputs").join(facts, ["model", "position"], "left").withColumn("output", F.try_element_at("outputs", F.lit(1))).join(shapes, ["model", "output"], "left")
    none = F.array().cast("array<string>")
    return out.select("model", "position", "name", "op_type", F.coalesce("inputs", none).alias("inputs"), "outputs", "output_shape", F.coalesce("parameters", F.lit(0)).alias("parameters"), F.coalesce("dtypes", none).alias("dtypes"))


def model_digests(files: DataFrame, parts: DataFrame, digests: DataFrame) -> DataFrame:
    """model, file, graph, parameters (digests), parameter_count, status, reason of files, from their structure and tensor digests.

    graph: inputs, outputs, layers in order and tensor shapes by name, no values; parameters: tensor digests by name.
    """
    text = F.concat_ws("|", "name", "dtype", _list("shape"))
    ends = _lines(parts.where("kind IN ('input', 'output')").join(parts.where("kind = 'tensor'").select("model", "name"), ["model", "name"], "left_anti"), "name", F.concat_ws("|", "kind", text))
    layers = _lines(model_layers(parts), "position", F.concat_ws("|", "name", "op_type", _list("inputs"), _list("outputs"), F.coalesce(_list("output_shape"), F.lit("?")), F.col("parameters").cast("string"), _list("dtypes")))
    shapes = _lines(parts.where("kind = 'tensor'"), "name", text)
    values = digests.groupBy("model").agg(F.sum("count").alias("parameter_count"), F.count_if(F.col("digest").isNull()).alias("faults")).join(_lines(digests, "name", F.concat_ws("|", text, "digest")), "model")
    bad = parts.where("kind = 'unreadable'").select("model", "reason")
    both = files.select("model").join(file_digests(files), "model", "left").join(bad, "model", "left")
    for name, lines in (("ends", ends), ("layers", layers), ("shapes", shapes), ("values", values)):
        both = both.join(lines.withColumnRenamed("lines", name), "model", "left")
    empty = F.lit("")
    graph = sha256(F.concat_ws("|", *(F.coalesce(c, empty) for c in ("ends", "layers", "shapes"))))
    sound = F.col("reason").isNull() & (F.coalesce("faults", F.lit(0)) == 0)
    return both.select(
        "model", "file", F.when(F.col("reason").isNull(), graph).alias("graph"), F.when(sound, F.coalesce("values", sha256(empty))).alias("parameters"), F.when(sound, F.coalesce("parameter_count", F.lit(0))).alias("parameter_count"),
        F.when(F.col("reason").isNotNull(), "UNREADABLE").when(~sound, "DAMAGED_TENSORS").otherwise("READ").alias("status"), "reason",
    )


# ---------------------------------------------------------------- writing


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def write_chain_models(tensors: DataFrame, path: str, producer: str = "plumbline", raw: bool = True) -> None:
    """tensors (model, position, name, rows, columns, values float) -> path/model.onnx, a chain of matrix products each.

    One task writes a model, tensor by tensor: parts of the graph come as fields of their own, which readers merge.  raw:
    whether values are raw data or typed data.  A task that is run again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        system.create_dir(folder, recursive=True)
        now, out, last = None, None, 0

        def close() -> None:
            shape = _field(1, _field(2, "rows")) + _field(1, _field(2, "columns"))
            ends = b"".join(_field(k, _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))) for k, name in ((11, "x0"), (12, f"x{last + 1}")))
            out.write(_field(7, _field(2, "chain") + ends) + _field(8, _field(1, "") + _field(2, 13)))
            out.close()

        for batch in batches:
            for k in range(batch.num_rows):
                model, position, name, rows, columns = (batch.column(c)[k].as_py() for c in range(5))
                values = batch.column(5)[k].values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                if model != now:
                    if out:
                        close()
                    out, now = system.open_output_stream(f"{folder}/{model}.onnx"), model
                    out.write(_field(1, 8) + _field(2, producer))
                node = _field(1, f"x{position}") + _field(1, name) + _field(2, f"x{position + 1}") + _field(3, f"mul{position}") + _field(4, "MatMul")
                tensor = _field(1, rows) + _field(1, columns) + _field(2, 1) + (_field(9, values) if raw else _field(4, values)) + _field(8, name)
                out.write(_field(7, _field(1, node) + _field(5, tensor)))
                last = position
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["model"])

    rows = tensors.select(F.col("model").cast("string").alias("model"), "position", "name", "rows", "columns", F.col("values").cast("array<float>").alias("values"))
    rows.repartition("model").sortWithinPartitions("model", "position").mapInArrow(run, "model string").write.format("noop").mode("overwrite").save()
