"""Provenance logs, trust stores, anchors and reports as tables; what cannot be read is kept as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.canonical import canonical_parts
from plumbline.functions.findings import sha256
from plumbline.sources.shared import written

# Fields of a signed record, and the schema versions that are understood.
RECORD = (
    "record struct<schema_version:string,record_id:string,hash_algorithm:string,"
    "input:struct<raw_input_digest:string,raw_input_size_bytes:bigint,normalized_input_digest:string,media_type:string,locator:string>,"
    "model:struct<model_id:string,file_sha256:string,graph_digest:string,parameter_digest:string,parameter_count:bigint,model_format:string>,"
    "preprocessing:struct<digest:string,quantization_places:int,config:string>,inference:struct<digest:string,quantization_places:int,config:string>,"
    "output:struct<digest:string,output:string>,sequence:struct<log_id:string,sequence_number:bigint,previous_record_digest:string>,timestamp:string,nonce:string,producer:string>,"
    "signature struct<algorithm:string,key_id:string,public_key:string,signature:string,signed_at:string>"
)
SUPPORTED_VERSIONS = ("1.0",)
FINDING = "finding_id string, attack_class string, severity string, confidence double, confidence_basis string, method string, coverage string, disposition string, disposition_rule string"


def numbered_lines(lines: DataFrame) -> DataFrame:
    """lines (value, of a text source) -> file, line (from 1), raw, whatever the number of splits of a file.

    A split's rows come in the order of the file; it counts them from the number of lines of the splits before it.  Blank lines
    count.  Batches of a stream may be numbered alike (foreachBatch), a new file from 1.
    """
    place = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    held = written(place, "log-lines")
    splits = held.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of the file
    ahead = splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return held.join(ahead, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "raw")


def parsed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file, line, raw -> (entries with record and signature, malformed lines with their start); blank ones are skipped."""
    lines = lines.where(F.trim("raw") != "").withColumn("j", F.from_json("raw", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | F.col("j.record").isNull()
    return lines.where(~bad).select("file", "line", "raw", "j.record", "j.signature"), lines.where(bad).select("file", "line", F.substring("raw", 1, 2000).alias("raw"))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSONL log -> (entries with line and raw, malformed lines with their number and start).

    Order is data: lines keep their numbers, though a file is read in as many splits as its size gives.
    """
    return parsed_lines(numbered_lines(spark.read.text(path)))


def flat(entries: DataFrame, *more: Column) -> DataFrame:
    """Entries as rows for verification, and more columns; the digest is worked out from the line's content, never read from it."""
    r = "record."
    return entries.select(
        F.col(r + "sequence.log_id").alias("log_id"), F.col("line").cast("long").alias("line"), F.col(r + "sequence.sequence_number").alias("sequence"), F.sha2(F.col("raw").cast("binary"), 256).alias("digest"), F.col(r + "sequence.previous_record_digest").alias("previous"),
        F.col(r + "nonce").alias("nonce"), F.col("signature.key_id").alias("key_id"), F.col("signature.signed_at").alias("signed_at"),
        F.sha2(F.concat_ws("|", r + "input.raw_input_digest", r + "model.file_sha256", r + "preprocessing.digest", r + "inference.digest").cast("binary"), 256).alias("subject"),
        F.col(r + "schema_version").isin(*SUPPORTED_VERSIONS).alias("schema_supported"), F.col(r + "record_id").alias("record_id"), F.col(r + "timestamp").alias("timestamp"),
        F.col(r + "input.raw_input_digest").alias("raw_input_digest"), F.col(r + "input.normalized_input_digest").alias("normalized_input_digest"), F.col(r + "model.file_sha256").alias("model_file_sha256"), F.col(r + "model.graph_digest").alias("model_graph_digest"),
        F.col(r + "model.parameter_digest").alias("model_parameter_digest"), F.col(r + "model.model_id").alias("model_id"), F.col(r + "preprocessing.digest").alias("preprocessing_digest"), F.col(r + "inference.digest").alias("inference_digest"), F.col(r + "output.digest").alias("output_digest"), *more,
    )


#: Parts of an entry whose canonical texts are digested.
SEALED = {
    "payload": "record", "unsigned": ("record", "record_id"), "entry": "", "preprocessing_content": "record.preprocessing.config", "inference_content": "record.inference.config", "output_content": "record.output.output",
}


def sealed(entries: DataFrame) -> DataFrame:
    """flat() with the digest of the canonical entry, and what checks of records, signatures and keys read.

    An entry without a canonical form has a fault, and a digest of its bytes, which no pointer names.
    """
    c = canonical_parts(F.col("raw"), SEALED)
    marked = entries.withColumn("c", c)
    hex_key = F.unhex(F.col("public_key"))
    rows = flat(
        marked,
        F.col("c.*"), F.col("record.schema_version").alias("schema_version"), F.col("signature.algorithm").alias("algorithm"), F.col("signature.public_key").alias("public_key"), F.col("signature.signature").alias("signature"),
    )
    short = F.concat(F.lit("PR-"), F.substring(sha256(F.col("unsigned")), 1, 16))
    rows = rows.withColumn("content_digest", short).withColumn("digest", F.when(F.col("fault").isNull(), sha256(F.col("entry"))).otherwise(F.col("digest")))
    return rows.withColumn("key_id_consistent", F.coalesce(F.sha2(hex_key, 256) == F.col("key_id"), F.lit(False))).drop("unsigned", "entry")


def append(entries: DataFrame, head: DataFrame | None, path: str) -> None:
    """Appends raw lines (line, raw, log_id, sequence, previous, digest) to a log; refuses a wrong number or back-pointer.

    head (log_id, head, entries) is what the logs hold now; None if they are new.
    """
    order = Window.partitionBy("log_id").orderBy("line")
    rows = entries.withColumn("k", F.row_number().over(order) - 1).withColumn("before", F.lag("digest").over(order))
    known = head if head is not None else entries.sparkSession.createDataFrame([], "log_id string, head string, entries long")
    rows = rows.join(known, "log_id", "left").withColumn("want", F.coalesce("entries", F.lit(0)) + F.col("k")).withColumn("link", F.coalesce("before", "head"))
    wrong = rows.where((F.col("sequence") != F.col("want")) | ~F.col("previous").eqNullSafe(F.col("link")))
    if not wrong.isEmpty():
        raise ValueError("an entry has the wrong sequence number or does not point back to the entry before it")
    entries.repartition("log_id").sortWithinPartitions("log_id", "line").select("raw").write.mode("append").text(path)


def read_findings(spark: SparkSession, path: str, module: str) -> DataFrame:
    """Findings of an upstream report; a report of another module, or a finding outside the vocabulary, is an error."""
    doc = spark.read.schema(f"module string, findings array<struct<{', '.join(f.replace(' ', ':', 1) for f in FINDING.split(', '))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not doc.where(F.col("module").isNull() | (F.col("module") != module) | F.col("findings").isNull()).isEmpty():
        raise ValueError(f"{path} is no report of module {module}")
    rows = doc.select(F.explode("findings").alias("f")).select("f.*")
    severe = F.col("severity").isin("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
    sound = severe & F.col("finding_id").isNotNull() & F.col("confidence").between(0, 1) & ((F.col("confidence_basis") != "DETERMINISTIC") | (F.col("confidence") == 1.0)) & ((F.col("confidence_basis") != "HEURISTIC_UNCALIBRATED") | (F.col("confidence") <= 0.6))
    if not rows.where(~F.coalesce(sound, F.lit(False))).isEmpty():
        raise ValueError(f"{path} has findings that break the schema")
    return rows


def optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame | None:
    """A JSON table, or None where there is none: an absent store means something else than an empty one."""
    return None if path is None else spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def markdown(findings: list[dict], title: str) -> str:
    """A short report of findings, most severe first."""
    order = {s: i for i, s in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))}
    rows = sorted(findings, key=lambda f: (order[f["severity"]], -f["confidence"], f["finding_id"]))
    lines = [f"# {title}", "", "| finding | severity | confidence | disposition |", "|-|-|-|-|"]
    return "\n".join(lines + [f"| {f['finding_id']} | {f['severity']} | {f['confidence']:.2f} | {f['disposition']} |" for f in rows]) + "\n"


def write_report(findings: DataFrame, coverage: DataFrame, path: str) -> None:
    """A report as JSON lines in two folders, findings and coverage, most severe findings first within their files."""
    order = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))), F.col("severity"))
    findings.sortWithinPartitions(order, F.desc("confidence"), "finding_id").write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/findings")
    coverage.write.mode("errorifexists").json(f"{path}/coverage")


def read_reference_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: the ids of a reference, from a JSON list or an object with a list `samples`; anything else is an error."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    ids = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json("value", "samples array<string>")["samples"])
    read = text.select(ids.alias("ids"))
    if not read.where("ids is null").isEmpty():
        raise ValueError(f"{path} holds no list of ids")
    return read.select(F.explode("ids").alias("id")).distinct()
