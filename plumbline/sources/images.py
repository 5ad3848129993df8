"""Image files as tables: facts of every declared sample, what is wrong with its file, and decoded pixels.

Files are listed and hashed by one source and decoded by Spark's image source in the JVM; both read any store that Spark
reads.  A declared file that neither lists is missing or empty: Arrow's file systems tell which, where they know the store.
A file that cannot be decoded, or whose decoded size passes a bound, is a row with its reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.findings import sha256
from plumbline.sources.datasets import IMAGE_SUFFIXES, _relative
from plumbline.sources.shared import written

#: Pixels of an image that is used, and bytes of a file that is hashed as one value.
MOST_PIXELS, MOST_BYTES = 178_956_970, 1 << 30
ISSUE = "code string, locator string, sample_id string"


def _sizes(missing: DataFrame, root: str) -> DataFrame:
    """sample_id, relpath, found (size in bytes; null if there is no such file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for relpath in batch.column(1).to_pylist():
                try:
                    path = f"{root.rstrip('/')}/{relpath}"
                    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                    info = system.get_file_info(name)
                    out.append(info.size if info.type == fs.FileType.File else None)
                except (OSError, pa.ArrowException):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["sample_id", "relpath", "found"])

    return missing.select("sample_id", "relpath").mapInArrow(run, "sample_id string, relpath string, found long")


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """relpath, height, width, channels, data of the image files under root; height is -1 where decoding fails."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(s for x in IMAGE_SUFFIXES for s in (x, x.upper())) + "}").load(root)
    path = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    return rows.select(path.alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").withColumn("relpath", _relative(root)).drop("path")


def image_facts(spark: SparkSession, samples: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """samples (sample_id, relpath) -> facts (sample_id, relpath, present, readable, size_bytes, file_sha256, width, height,
    error) and issues of their files (missing_image_file, empty_file, unreadable_image).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    hashed = files.select("path", "length", F.sha2("content", 256).alias("file_sha256")).withColumn("relpath", _relative(root)).drop("path")
    sizes = decoded(spark, root).select("relpath", "height", "width")
    known = samples.select("sample_id", "relpath").join(hashed, "relpath", "left").join(sizes, "relpath", "left")
    known = written(known, "image-files")
    there = written(_sizes(known.where("length IS NULL"), root), "image-sizes")
    rows = known.join(there.select("sample_id", "found"), "sample_id", "left")
    size = F.coalesce("length", "found")
    big = F.col("height").cast("long") * F.col("width") > MOST_PIXELS
    error = (
        F.when(size.isNull(), "file not found").when(size == 0, "empty file").when(size > MOST_BYTES, f"more than {MOST_BYTES} bytes")
        .when(F.coalesce(F.col("height"), F.lit(-1)) <= 0, "cannot be decoded").when(big, f"more than {MOST_PIXELS} pixels")
    )
    empty = sha256(F.lit(""))
    ok = F.col("error").isNull()
    facts = rows.withColumn("error", error).select(
        "sample_id", "relpath", size.isNotNull().alias("present"), ok.alias("readable"), F.coalesce(size, F.lit(0).cast("long")).alias("size_bytes"),
        F.when(size == 0, empty).otherwise(F.col("file_sha256")).alias("file_sha256"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"), "error",
    )
    code = F.when(~F.col("present"), "missing_image_file").when(F.col("size_bytes") == 0, "empty_file").otherwise("unreadable_image")
    return facts, facts.where("NOT readable").select(code.alias("code"), F.col("relpath").alias("locator"), "sample_id")


def pixels(spark: SparkSession, facts: DataFrame, root: str) -> DataFrame:
    """sample_id, height, width, channels, data of the readable samples, for image_features()."""
    return facts.where("readable").select("sample_id", "relpath").join(decoded(spark, root), "relpath").select("sample_id", "height", "width", "channels", "data")
