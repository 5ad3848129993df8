"""Model files: what each kind offers here, and inference of stored models over a table of probes.

A runtime that is not installed makes a model unavailable, with the reason; it is no error.  Files that would have to be
unpickled are never loaded.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix -> format, module that runs it, what it offers.
FORMATS = {
    ".onnx": ("onnx", "onnxruntime", ("inference", "graph", "parameters")),
    ".ts": ("torchscript", "torch", ("inference", "graph", "parameters", "activations", "gradients")),
    ".pt": ("pickled", None, ()),
    ".pth": ("pickled", None, ()),
}
#: Bytes of a model file that is broadcast to the executors, at most.
LARGEST = 512 << 20


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """model (path), format, file_sha256, size, status and reason of the model files under a path; digests need no runtime."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    known = [(s, f, m is not None and importlib.util.find_spec(m) is not None, "its runtime is not installed" if m else "loading it would run what it holds") for s, (f, m, _) in FORMATS.items()]
    table = spark.createDataFrame(known, "suffix string, format string, able boolean, why string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", suffix.alias("suffix"), F.sha2("content", 256).alias("file_sha256"))
    rows = files.join(F.broadcast(table), "suffix", "left")  # a row for each format
    status = F.when(F.col("format").isNull(), "UNSUPPORTED").when(F.col("able"), "AVAILABLE").otherwise("UNAVAILABLE")
    reason = F.when(F.col("format").isNull(), "no reader for this kind of file").when(~F.col("able"), F.col("why"))
    return rows.select(F.col("path").alias("model"), "format", "file_sha256", F.col("length").alias("size"), status.alias("status"), reason.alias("reason"))


def model_capabilities(models: DataFrame) -> DataFrame:
    """models (list_models) -> model, capability: none for those that are not available."""
    rows = [(f, c) for f, _, offers in FORMATS.values() for c in offers]
    table = models.sparkSession.createDataFrame(rows, "format string, capability string")
    return models.where("status = 'AVAILABLE'").join(F.broadcast(table), "format").select("model", "capability")


def softmax(scores: np.ndarray) -> np.ndarray:
    """Rows of scores as probabilities."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def infer(probes: DataFrame, model: str, gives_probabilities: bool = False) -> DataFrame:
    """probes (probe, features array<float>) -> probe, probabilities of an ONNX model's first output, one session for each task.

    Whether the model gives probabilities or scores is the caller's knowledge: a batch cannot tell for sure.
    """
    spark = probes.sparkSession
    file = spark.read.format("binaryFile").load(model).select("length", "content").where(F.col("length") <= LARGEST).first()
    if file is None:
        raise ValueError(f"{model} is larger than {LARGEST} bytes")
    shared = spark.sparkContext.broadcast(bytes(file.content))  # at most LARGEST bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(shared.value, options, providers=["CPUExecutionProvider"])
        source = session.get_inputs()[0]
        shape = [d if isinstance(d, int) else -1 for d in source.shape[1:]]
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, *(shape or [-1]))
                out = np.asarray(session.run(None, {source.name: x})[0], np.float64).reshape(batch.num_rows, -1)
                out = out if gives_probabilities else softmax(out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["probe", "probabilities"])

    return probes.select("probe", "features").mapInArrow(run, f"probe {probes.schema['probe'].dataType.simpleString()}, probabilities array<double>")
