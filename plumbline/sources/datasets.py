"""Readers of annotated image collections: schema on read, defects recorded as issues instead of raised.

A reader returns (samples, issues).  samples: sample_id, relpath, labels, boxes (category, box as x1 y1 x2 y2, in pixels or
normalised as the source has it), width, height.  issues: code, locator, sample_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Schemas of the two annotation formats, and the extensions that count as images.
COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


@dataclass(frozen=True)
class Adapter:
    name: str
    matches: Callable[[SparkSession, str], bool]
    load: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]


def _issue(rows: DataFrame, code: str, locator: str, sample: str | None = None) -> DataFrame:
    who = F.col(sample).cast("string") if sample else F.lit(None).cast("string")
    return rows.select(F.lit(code).alias("code"), F.col(locator).cast("string").alias("locator"), who.alias("sample_id"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A COCO annotation file: the first of repeated image ids counts; unknown categories keep a name of their own."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.posexplode("images").alias("at", "i")).select("at", "i.*")
    images = images.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    first = images.where("k = 1 and id is not null and file_name is not null")
    notes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    notes = notes.join(F.broadcast(names), "category_id", "left")  # a row for each category
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    good = (F.size("bbox") == 4) & (w > 0) & (h > 0)
    known = notes.join(first.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    named = known.withColumn("category", F.coalesce("category", F.concat(F.lit("__unknown_"), F.col("category_id"), F.lit("__"))))
    boxes = named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.when(good, F.struct("annotation_id", "category", F.array(x, y, x + w, y + h).alias("box"))))).alias("boxes"), F.array_sort(F.collect_set("category")).alias("labels"))
    samples = first.join(boxes.withColumnRenamed("image_id", "id"), "id", "left").select(
        F.col("id").cast("string").alias("sample_id"), F.col("file_name").alias("relpath"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)).alias("boxes"), "width", "height"
    )
    issues = [
        _issue(images.where("k > 1"), "duplicate_id", "file_name", "id"),
        _issue(images.where("id is null or file_name is null"), "malformed_record", "at"),
        _issue(notes.join(first.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "orphan_annotation", "annotation_id"),
        _issue(known.where("category is null"), "unknown_category", "annotation_id", "image_id"),
        _issue(known.where(~F.coalesce(good, F.lit(False))), "invalid_bbox", "annotation_id", "image_id"),
        _issue(samples.where(F.size("labels") == 0), "unlabelled_sample", "relpath", "sample_id"),
    ]
    out = issues[0]
    for x in issues[1:]:
        out = out.unionByName(x)
    return samples, out


def _relative(path: str) -> F.Column:
    root = path.rstrip("/")
    return F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.split("://")[-1].lstrip("/")) + "/", "")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def _files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(*(("path", "length", "content") if content else ("path", "length"))).withColumn("relpath", _relative(path)).where(~F.col("relpath").rlike(r"(^|/)\."))


def read_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One directory for each class: the first directory of a path is the label."""
    files = _files(spark, path).withColumn("label", F.nullif(F.regexp_extract("relpath", "^([^/]+)/", 1), F.lit("")))
    image = F.lower(F.regexp_extract("relpath", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)
    none = F.array().cast("array<struct<annotation_id:bigint,category:string,box:array<double>>>")
    samples = files.where(image & F.col("label").isNotNull()).select(F.col("relpath").alias("sample_id"), "relpath", F.array("label").alias("labels"), none.alias("boxes"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    issues = _issue(files.where(~image), "unsupported_extension", "relpath").unionByName(_issue(files.where(image & (F.col("length") == 0)), "empty_file", "relpath", "relpath"))
    return samples, issues


def read_yolo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """images/ and labels/*.txt with lines of class index and a normalised centre box; classes.txt names the classes."""
    root = path.rstrip("/")
    images = _files(spark, f"{root}/images").withColumn("stem", F.regexp_replace("relpath", r"\.[^./]+$", ""))
    names = spark.read.text(f"{root}/classes.txt", wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), F.trim), lambda x: x != "")).alias("class_id", "category"))
    lines = spark.read.text(f"{root}/labels", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).where("line != ''")
    lines = lines.withColumn("stem", F.regexp_replace(_relative(f"{root}/labels"), r"\.txt$", "")).withColumn("f", F.split("line", r"\s+"))
    number = lambda i: F.try_element_at("f", F.lit(i)).try_cast("double")
    parsed = lines.select("stem", "line", F.try_element_at("f", F.lit(1)).try_cast("int").alias("class_id"), F.array(*(number(i) for i in range(2, 6))).alias("b"))
    whole = F.col("class_id").isNotNull() & F.forall("b", lambda x: x.isNotNull())
    inside = F.forall("b", lambda x: (x >= 0) & (x <= 1)) & (F.get("b", F.lit(2)) > 0) & (F.get("b", F.lit(3)) > 0)
    named = parsed.join(F.broadcast(names), "class_id", "left")  # a row for each class
    good = named.where(whole & inside & F.col("category").isNotNull())
    cx, cy, w, h = (F.get("b", F.lit(i)) for i in range(4))
    box = F.array(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)
    boxes = good.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct(F.lit(None).cast("bigint").alias("annotation_id"), "category", box.alias("box")))).alias("boxes"), F.array_sort(F.collect_set("category")).alias("labels"))
    samples = images.join(boxes, "stem", "left").select(F.col("stem").alias("sample_id"), "relpath", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "boxes", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    issues = [
        _issue(named.where(~whole), "malformed_record", "line", "stem"),
        _issue(named.where(whole & F.col("category").isNull()), "unknown_category", "line", "stem"),
        _issue(named.where(whole & ~inside), "invalid_bbox", "line", "stem"),
        _issue(lines.select("stem").distinct().join(images, "stem", "left_anti"), "orphan_annotation", "stem"),
        _issue(samples.where(F.size("labels") == 0), "unlabelled_sample", "relpath", "sample_id"),
    ]
    out = issues[0]
    for x in issues[1:]:
        out = out.unionByName(x)
    return samples, out


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(1).isEmpty()
    except AnalysisException:
        return False


ADAPTERS: dict[str, Adapter] = {
    "coco": Adapter("coco", lambda spark, path: path.endswith(".json"), read_coco),
    "folder": Adapter("folder", lambda spark, path: not path.endswith(".json") and not _exists(spark, f"{path}/classes.txt"), read_folder),
    "yolo": Adapter("yolo", lambda spark, path: not path.endswith(".json") and _exists(spark, f"{path}/classes.txt"), read_yolo),
}


def register_adapter(adapter: Adapter) -> None:
    if adapter.name in ADAPTERS:
        raise ValueError(f"adapter {adapter.name!r} is registered already")
    ADAPTERS[adapter.name] = adapter


def choose_adapter(spark: SparkSession, path: str) -> str:
    """The only adapter that matches; none or several is an error."""
    found = [a.name for _, a in sorted(ADAPTERS.items()) if a.matches(spark, path)]
    if len(found) != 1:
        raise ValueError(f"{path}: {'no adapter matches' if not found else 'several adapters match: ' + ', '.join(found)}")
    return found[0]


def load(spark: SparkSession, path: str, adapter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads by the named adapter, or by the only one that matches."""
    return ADAPTERS[adapter or choose_adapter(spark, path)].load(spark, path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """{"samples": {path: contributor or {contributor, batch, source}}} -> sample_id, contributor, batch, source."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "samples map<string,string>", {"mode": "FAILFAST"}).alias("d"))
    rows = doc.select(F.explode("d.samples").alias("sample_id", "v")).withColumn("o", F.from_json("v", "contributor string, batch string, source string"))
    plain = ~F.col("v").startswith("{")
    return rows.select("sample_id", F.when(plain, F.col("v")).otherwise(F.col("o.contributor")).alias("contributor"), F.when(~plain, F.col("o.batch")).alias("batch"), F.when(~plain, F.col("o.source")).alias("source"))
