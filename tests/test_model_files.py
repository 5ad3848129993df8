"""Model files: a small ONNX model, written byte by byte, and files that cannot be run."""

import hashlib

import pytest

from plumbline.sources import model_files


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def onnx(operation, width=3):
    """A model of one operation on rows of so many numbers."""
    dims = field(1, field(2, "n")) + field(1, field(1, width))
    value = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))
    node = field(1, "x") + field(2, "y") + field(4, operation)
    graph = field(1, node) + field(2, "g") + field(11, value("x")) + field(12, value("y"))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_models_are_listed_and_run(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    for name, data in (("a.onnx", onnx("Identity")), ("b.onnx", onnx("Softmax")), ("c.pt", b"pickle"), ("d.bin", b"?")):
        (tmp_path / name).write_bytes(data)
    got = {r.model.rsplit("/", 1)[1]: r for r in model_files.list_models(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.onnx": "AVAILABLE", "b.onnx": "AVAILABLE", "c.pt": "UNAVAILABLE", "d.bin": "UNSUPPORTED"}
    assert got["a.onnx"].file_sha256 == hashlib.sha256(onnx("Identity")).hexdigest() and got["c.pt"].reason
    offers = model_files.model_capabilities(model_files.list_models(spark, str(tmp_path))).collect()
    assert {r.capability for r in offers} == {"inference", "graph", "parameters"} and len(offers) == 6
    probes = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(5)], "probe long, features array<float>")
    one, two = ({r.probe: [round(p, 6) for p in r.probabilities] for r in model_files.infer(probes, str(tmp_path / n), n == "b.onnx").collect()} for n in ("a.onnx", "b.onnx"))
    assert one == two and len(one) == 5 and all(abs(sum(p) - 1) < 1e-5 for p in one.values()) and one[4][0] > 0.9
