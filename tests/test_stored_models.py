"""Stored models: digests from files under other writings, blocks of values, and files that cannot be read."""

import hashlib
import struct

import numpy as np
import pytest
from test_model_files import field, varint

from plumbline.operators import models
from plumbline.sources import model_files
from plumbline.sources import stored_models as stored

VALUES = [0.5, -1.25, float("nan"), 3.0, float("inf"), 1e-7]


def tensor(name, dims, kind, data, number=9, packed=True):
    shape = field(1, b"".join(varint(d) for d in dims)) if packed else b"".join(field(1, d) for d in dims)
    return shape + field(2, kind) + field(8, name) + field(number, data)


def value(name, dims, kind=1):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def node(inputs, outputs, kind, name=""):
    return b"".join(field(1, x) for x in inputs) + b"".join(field(2, x) for x in outputs) + field(3, name) + field(4, kind)


def model(tensors, producer="one", reverse=False, nodes=None):
    nodes = nodes or [node(["x", "w"], ["h"], "MatMul", "mul"), node(["h", "b"], ["y"], "Add")]
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + b"".join(field(5, t) for t in (tensors[::-1] if reverse else tensors))
    graph += field(11, value("x", ["n", 2])) + field(12, value("y", ["n", 3])) + field(13, value("h", ["n", 3]))
    return field(1, 8) + field(2, producer) + field(7, graph) + field(8, field(1, "") + field(2, 13)) + field(14, field(1, "architecture") + field(2, "tiny"))


def floats(values):
    return np.array(values, "<f4").tobytes()


def weights(values=VALUES, raw=True, packed=True):
    return [tensor("w", [2, 3], 1, floats(values), 9 if raw else 4, packed), tensor("b", [3], 7, struct.pack("<3q", 1, -2, 2**60) if raw else b"".join(varint(v % 2**64) for v in (1, -2, 2**60)), 9 if raw else 7)]


def read(spark, folder):
    files = stored.model_files(spark, str(folder))
    parts = stored.read_structure(files)
    blocks = stored.tensor_blocks(parts)
    digests = stored.tensor_digests(blocks)
    return files, parts, blocks, digests, {r.model.rsplit("/", 1)[1]: r for r in stored.model_digests(files, parts, digests).collect()}


def test_the_three_digests_move_apart(spark, tmp_path):
    other = [*VALUES[:3], 3.001, *VALUES[4:]]
    files = {
        "a.onnx": model(weights()), "again.onnx": model(weights(raw=False, packed=False), "two", reverse=True), "weights.onnx": model(weights(other)),
        "shape.onnx": model([tensor("w", [3, 2], 1, floats(VALUES)), weights()[1]]), "graph.onnx": model(weights(), nodes=[node(["x", "w"], ["h"], "Gemm", "mul"), node(["h", "b"], ["y"], "Add")]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = read(spark, tmp_path)[-1]
    a = got["a.onnx"]
    assert a.status == "READ" and a.parameter_count == 9 and a.file == hashlib.sha256(files["a.onnx"]).hexdigest()
    assert (got["again.onnx"].graph, got["again.onnx"].parameters) == (a.graph, a.parameters) and got["again.onnx"].file != a.file
    assert got["weights.onnx"].graph == a.graph and got["weights.onnx"].parameters != a.parameters
    assert got["shape.onnx"].graph != a.graph and got["shape.onnx"].parameters != a.parameters
    assert got["graph.onnx"].graph != a.graph and got["graph.onnx"].parameters == a.parameters
    rows = spark.createDataFrame([(k, r.file, r.graph, r.parameters) for k, r in got.items()], "model string, file string, graph string, parameters string")
    base = rows.where("model = 'a.onnx'").drop("model").crossJoin(rows.select("model"))
    assert {r.model: r.relation for r in models.identity(rows, base).collect()} == {
        "a.onnx": "IDENTICAL", "again.onnx": "RESERIALISED", "weights.onnx": "SAME_ARCHITECTURE_DIFFERENT_WEIGHTS", "shape.onnx": "DIFFERENT_MODEL", "graph.onnx": "DIFFERENT_MODEL"
    }


def test_layers_and_declarations(spark, tmp_path):
    (tmp_path / "a.onnx").write_bytes(model(weights()))
    _, parts, _, _, _ = read(spark, tmp_path)
    layers = sorted(stored.model_layers(parts).collect(), key=lambda r: r.position)
    assert [(r.name, r.op_type, r.inputs, r.outputs, r.output_shape, r.parameters, r.dtypes) for r in layers] == [
        ("mul", "MatMul", ["x"], ["h"], [-1, 3], 6, ["float32"]), ("Add_1", "Add", ["h"], ["y"], [-1, 3], 3, ["int64"])
    ]
    said = {r.name: r.reason for r in parts.where("kind = 'declared'").collect()}
    assert said == {"ir_version": "8", "producer_name": "one", "opset.ai.onnx": "13", "meta.architecture": "tiny"}


@pytest.mark.parametrize("raw", [True, False])
def test_long_tensors_come_in_blocks(spark, tmp_path, raw):
    n = 2 * stored.BLOCK + 7
    x = (np.arange(n) * 0.001).astype("<f4")
    whole = np.arange(n, dtype=np.int64) * 997 - 10**6
    data = whole.astype("<i8").tobytes() if raw else b"".join(varint(int(v) % 2**64) for v in whole)
    (tmp_path / "a.onnx").write_bytes(model([tensor("w", [n], 1, x.tobytes(), 9 if raw else 4), tensor("b", [n], 7, data, 9 if raw else 7)]))
    _, _, blocks, digests, got = read(spark, tmp_path)
    rows = sorted((r.name, r.block, len(r.units)) for r in blocks.select("name", "block", "units").collect())
    assert rows == [(k, b, s) for k in "bw" for b, s in ((0, stored.BLOCK), (1, stored.BLOCK), (2, 7))]
    held = {r.name: r.digest for r in digests.collect()}
    for name, kind, units in (("w", "float32", np.rint(x.astype(float) * 1e6).astype(np.int64)), ("b", "int64", whole)):
        shas = [hashlib.sha256(",".join(map(str, units[k : k + stored.BLOCK].tolist())).encode()).hexdigest() for k in range(0, n, stored.BLOCK)]
        assert held[name] == hashlib.sha256(f"{kind}|{n}|{','.join(shas)}".encode()).hexdigest()
    assert got["a.onnx"].parameter_count == 2 * n


def test_other_types_and_data_beside_the_file(spark, tmp_path):
    half, brain = np.array([1.5, -0.25], "<f2"), np.array([1.5, -0.25], "<f4").view("<u4") >> 16
    (tmp_path / "data.bin").write_bytes(b"????" + floats([4.0, 5.0]))
    aside = field(1, 2) + field(2, 1) + field(8, "aside") + b"".join(field(13, field(1, k) + field(2, v)) for k, v in (("location", "data.bin"), ("offset", "4"), ("length", "8")))
    out = field(1, 2) + field(2, 1) + field(8, "out") + field(13, field(1, "location") + field(2, "../x"))
    (tmp_path / "a.onnx").write_bytes(model([
        tensor("half", [2], 10, half.tobytes()), tensor("typed", [2], 10, b"".join(varint(int(v)) for v in half.view("<u2")), 5), tensor("brain", [2], 16, brain.astype("<u2").tobytes()), tensor("bool", [3], 9, b"\1\0\1"),
        tensor("double", [1], 11, struct.pack("<d", 0.1), 10), tensor("words", [1], 8, b"text", 6), tensor("short", [3], 1, floats([1.0])), tensor("few", [3], 7, varint(5), 7), tensor("none", [0, 4], 1, b""), tensor("one", [], 1, floats([2.5])), aside, out,
    ]))
    _, _, blocks, digests, got = read(spark, tmp_path)
    values = {r["name"]: r["values"] for r in blocks.where("reason IS NULL").collect()}
    assert values["half"] == values["typed"] == values["brain"] == [1.5, -0.25]
    assert values["bool"] == [1, 0, 1] and values["double"] == [0.1] and values["aside"] == [4.0, 5.0] and values["none"] == [] and values["one"] == [2.5] and "words" not in values
    assert {r["name"] for r in digests.where("digest IS NULL").collect()} == {"short", "few", "out"}
    assert got["a.onnx"].status == "DAMAGED_TENSORS" and got["a.onnx"].parameters is None and got["a.onnx"].graph


def test_what_cannot_be_read_is_said(spark, tmp_path):
    good = model(weights())
    for name, data in (("cut.onnx", good[:-40]), ("text.onnx", b"no model at all"), ("good.onnx", good), ("long.onnx", field(1, 8) + varint(7 << 3 | 2) + varint(1 << 40))):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "other.txt").write_bytes(b"")
    got = read(spark, tmp_path)[-1]
    assert {k: r.status for k, r in got.items()} == {"cut.onnx": "UNREADABLE", "text.onnx": "UNREADABLE", "long.onnx": "UNREADABLE", "good.onnx": "READ"}
    assert all(r.reason and r.graph is None for k, r in got.items() if k != "good.onnx")


def test_a_runtime_reads_what_is_written(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    rows = spark.createDataFrame([(1, 0, "w0", 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (1, 1, "w1", 3, 1, [1.0, 1.0, 1.0])], "model int, position int, name string, rows int, columns int, values array<float>")
    for raw in (True, False):
        folder = str(tmp_path / str(raw))
        stored.write_chain_models(rows, folder, raw=raw)
        assert read(spark, folder)[-1]["1.onnx"].parameter_count == 9
        probes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "probe int, features array<float>")
        assert {r.probe: r.probabilities for r in model_files.infer(probes, f"{folder}/1.onnx", True).collect()} == {0: [6.0], 1: [30.0]}
