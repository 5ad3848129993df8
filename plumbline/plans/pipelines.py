"""Whole assessments: a dataset scan, the verification of a log, and the fusion of their findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import findings as fi
from plumbline.functions import signatures
from plumbline.operators import assessment, contributors, duplicates, fusion, integrity, neighbours, populations, provenance, records
from plumbline.functions.statistics import dot
from plumbline.operators.features import image_features, object_features
from plumbline.operators.outliers import combined_outliers
from plumbline.operators.ranks import running_total
from plumbline.sources import datasets, images, logs
from plumbline.sources.shared import written

FINDING = ("finding_id", "attack_class", "asset", "contributor", "severity", "confidence", "basis", "detector", "coverage", "disposition", "disposition_rule")
#: What a dataset scan can report on; what it was not given the data for stays NOT_ASSESSED.
DATASET_CLASSES = ("duplicate_flood", "near_duplicate_flood", "label_flip", "metadata_inconsistency", "ood_insertion")


@dataclass
class Report:
    findings: DataFrame
    coverage: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def digest(self) -> str:
        """Digest of what was found, whatever the order of rows."""
        return assessment.stable_digest(self.findings)


def _finding(rows: DataFrame, detector: str, attack_class: str, asset: F.Column, contributor: F.Column, severity: F.Column, confidence: F.Column, basis: str) -> DataFrame:
    what, why = fi.disposition(severity, confidence, F.lit(basis), F.lit("SUPPORTED"))
    asset = asset.cast("string")
    return rows.select(
        fi.finding_id(detector, attack_class, asset, F.array(asset)).alias("finding_id"), F.lit(attack_class).alias("attack_class"), asset.alias("asset"), contributor.cast("string").alias("contributor"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), F.lit(basis).alias("basis"), F.lit(detector).alias("detector"), F.lit("SUPPORTED").alias("coverage"), what.alias("disposition"), why.alias("disposition_rule"),
    )


def scan_dataset(samples: DataFrame, vectors: DataFrame | None = None, issues: DataFrame | None = None, reference: DataFrame | None = None, pairs: DataFrame | None = None) -> Report:
    """samples (id, content, contributor), vectors (id, label, vector), issues (code, locator, sample_id), reference (id).

    pairs (a, b, distance, cosine): near duplicates of samples that are no texts; those of texts are found here.

    Detectors run in a fixed order; each that lacks its input leaves its class NOT_ASSESSED with a row that says so.  Without
    a declared reference the rows themselves are the (weaker) reference; a label finding of an outlier is qualified.
    """
    spark, none = samples.sparkSession, F.lit(None).cast("string")
    groups = written(duplicates.exact_groups(samples, "id", F.col("content"), "contributor"), "exact")
    parts = [_finding(groups, "exact_duplicate", "duplicate_flood", F.col("representative"), F.col("contributor"), F.col("severity"), F.lit(1.0), "DETERMINISTIC")]
    done, tables = ["duplicate_flood", "near_duplicate_flood"], {"exact": groups}
    if pairs is None:
        pairs = written(duplicates.near_text_links(duplicates.blocks_of_texts(samples, "id", "content")), "pairs")
    clusters = written(duplicates.near_clusters(pairs), "near")
    tables["near"] = clusters
    parts.append(_finding(clusters, "near_duplicate", "near_duplicate_flood", F.col("component"), none, F.col("severity"), F.col("confidence"), "HEURISTIC_UNCALIBRATED"))
    if issues is not None:
        found = integrity.integrity_findings(issues).where("sample_id is not null")
        parts.append(_finding(found, "integrity", "metadata_inconsistency", F.col("sample_id"), none, F.col("severity"), F.lit(1.0), "DETERMINISTIC"))
        done.append("metadata_inconsistency")
    if vectors is not None:
        points, chosen = populations.select_reference(vectors, reference)
        tables["reference"] = chosen
        outliers = None
        if chosen.first().status == "ASSESSED":
            scores = combined_outliers(points, reference is not None)
            tables["outliers"] = scores
            flagged = scores.where("flagged")
            outliers = written(flagged if reference is None else flagged.where("not reference"), "outliers")
            parts.append(_finding(outliers, "ood", "ood_insertion", F.col("id"), none, F.col("severity"), F.lit(0.40), "HEURISTIC_UNCALIBRATED"))
            done.append("ood_insertion")
        labels = written(neighbours.label_consistency(vectors, duplicates.duplicate_members(samples, "id", "content", pairs)), "labels")
        tables["labels"] = labels
        flips = labels.where("flagged").join(samples.select("id", "contributor"), "id", "left")
        if outliers is not None:
            flips = populations.qualify_by_outliers(flips, outliers)
        parts.append(_finding(flips, "label_consistency", "label_flip", F.col("id"), F.col("contributor"), F.col("severity"), F.lit(0.45), "HEURISTIC_UNCALIBRATED"))
        done.append("label_flip")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = written(found, "findings")
    copies = samples.select("id", "contributor", fi.sha256(F.col("content")).alias("digest")).join(groups.select("digest"), "digest", "left_semi")
    tests = contributors.over_represented(samples.select("id", "contributor"), copies.select("id", F.lit("duplicate_flood").alias("attack_class")), 1.0, "HIGH").where("reported")
    tables["contributors"] = tests
    found = found.unionByName(_finding(tests, "contributor_aggregate", "duplicate_flood", F.col("contributor"), F.col("contributor"), F.col("severity"), F.col("confidence"), "STATISTICAL"))
    registry = spark.createDataFrame([(c,) for c in DATASET_CLASSES], "attack_class string")
    return Report(found, fusion.merge_coverage(registry, spark.createDataFrame([(c, "SUPPORTED") for c in done], "attack_class string, coverage string")), tables)


def image_pairs(features: DataFrame) -> DataFrame:
    """features (id, phash, embedding) -> near pairs a, b, distance, cosine: hashes that meet, descriptors that confirm them."""
    codes = features.select("id", F.shiftrightunsigned("phash", 32).alias("hi"), F.col("phash").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    left, right = (features.select(F.col("id").alias(i), vector.alias(v)) for i, v in (("a", "va"), ("b", "vb")))
    met = duplicates.hamming_pairs(codes).join(left, "a").join(right, "b")
    cosine = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    return met.select("a", "b", "distance", cosine.alias("cosine")).where(F.col("cosine") >= duplicates.MIN_COSINE)


def scan_images(spark: SparkSession, path: str, root: str | None = None, adapter: str | None = None, contributors: DataFrame | None = None, reference: DataFrame | None = None) -> Report:
    """A scan of an annotated image collection from its files; root holds the images (else path), contributors (sample_id, contributor).

    Files are measured and decoded; faults of files, declared sizes and boxes are issues; hashes and descriptors of whole
    images give duplicates and outliers, and those of annotated objects are what labels are judged by, where there are any.
    Asset names of findings are numbers; table `names` tells the samples.
    """
    adapter = adapter or datasets.choose_adapter(spark, path)
    root = (root or path).rstrip("/") + ("/images" if adapter == "yolo" and root is None else "")
    samples, issues = datasets.load(spark, path, adapter)
    samples = written(running_total(samples, "sample_id", out="id"), "image-samples")
    facts, faults = images.image_facts(spark, samples, root)
    facts = written(facts, "image-facts")
    sizes = facts.select(F.col("sample_id"), "width", "height").where("width IS NOT NULL")
    declared = samples.select(F.col("sample_id").alias("id"), F.col("width").alias("declared_width"), F.col("height").alias("declared_height"))
    wrong = populations.dimension_mismatches(declared, facts.withColumnRenamed("sample_id", "id"))
    boxes = samples.select("sample_id", F.posexplode("boxes").alias("at", "b")).join(sizes, "sample_id").select("sample_id", "at", F.col("b.category").alias("label"), F.col("b.box").alias("box"), "width", "height")
    if adapter == "yolo":
        x1, y1, x2, y2 = (F.get("box", F.lit(i)) for i in range(4))
        boxes = boxes.withColumn("box", F.array(x1 * F.col("width"), y1 * F.col("height"), x2 * F.col("width"), y2 * F.col("height")))
    outside = boxes.withColumn("code", integrity.bbox_issue(F.col("box"), F.col("width"), F.col("height"))).where("code IS NOT NULL")
    issues = issues.unionByName(faults).unionByName(wrong.select(F.lit("dimension_mismatch").alias("code"), F.col("id").alias("locator"), F.col("id").alias("sample_id")))
    issues = issues.unionByName(outside.select("code", F.concat_ws(":", "sample_id", "at").alias("locator"), "sample_id"))
    whole = images.pixels(spark, facts, root)
    features = written(image_features(whole).where("valid").join(samples.select("sample_id", "id"), "sample_id"), "image-features")
    crops = populations.object_crops(boxes.select(F.col("sample_id").alias("id"), F.col("at").cast("long").alias("annotation"), "label", "box", "width", "height")).withColumnRenamed("id", "sample_id")
    objects = written(object_features(whole, crops), "image-objects")
    who = contributors if contributors is not None else spark.createDataFrame([], "sample_id string, contributor string")
    rows = samples.select("id", "sample_id").join(facts.select("sample_id", "file_sha256"), "sample_id").join(who.select("sample_id", "contributor"), "sample_id", "left").select("id", F.col("file_sha256").alias("content"), "contributor")
    labels = samples.where(F.size("labels") > 0).select("id", F.col("labels")[0].alias("label"))
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    vectors = features.select("id", vector).join(labels, "id")
    known = None if reference is None else samples.join(reference.select("sample_id"), "sample_id", "left_semi").select("id")
    named = issues.withColumn("sample_id", F.col("sample_id").cast("string"))
    report = scan_dataset(rows, vectors, named, known, written(image_pairs(features), "image-pairs"))
    report.tables |= {"names": samples.select("id", "sample_id"), "facts": facts, "features": features, "issues": named, "objects": objects}
    if not objects.isEmpty():
        numbered = written(running_total(objects.withColumn("name", F.concat_ws(":", "sample_id", F.lpad(F.col("annotation").cast("string"), 12, "0"))), "name", out="id"), "image-units")
        apart = numbered.join(samples.select("sample_id", F.col("id").alias("group")), "sample_id").select("id", "group")
        report.tables["object_labels"] = neighbours.label_consistency(numbered.select("id", "label", vector), apart).join(numbered.select("id", "sample_id", "annotation"), "id")
    return report


def verify_log(spark: SparkSession, path: str, trust: DataFrame | None = None, anchors: DataFrame | None = None, observed: DataFrame | None = None, expected: DataFrame | None = None, whole: bool = False) -> Report:
    """Checks every record of a JSONL log: chain, replay, keys and expectations (by digest), with findings by failure code.

    whole: records are sealed, that is, entries point to the canonical digest of the one before, ids follow from contents, and
    signatures are over the canonical record; then identity, self-consistency, required fields, signatures and the authority
    of keys are checked besides.
    """
    entries, bad = logs.read_log(spark, path)
    rows = written(logs.sealed(entries) if whole else logs.flat(entries), "records")
    links = written(provenance.chain_links(rows), "links")
    key = "digest"
    checks = provenance.chain_checks(links, key)
    if whole:
        sound = rows.where("fault IS NULL")
        for more in (records.record_checks(sound, key), records.authority_checks(sound, trust, key), signatures.signature_checks(sound, key, F.col("payload"))):
            checks = checks.unionByName(more)
        broken_form = rows.where("fault IS NOT NULL").select(key, F.lit("canonical_form").alias("check"), F.lit("FAIL").alias("outcome"), F.lit("MALFORMED_RECORD").alias("failure"))
        checks = checks.unionByName(broken_form)
    else:
        checks = checks.unionByName(provenance.key_checks(rows, trust, key))
    checks = checks.unionByName(provenance.replay_checks(provenance.replay_verdicts(rows.withColumn("seen", F.col("line")), observed), key))
    if expected is not None:
        checks = checks.unionByName(provenance.expectation_checks(rows, expected, key))
    unread = F.when(~F.col("schema_supported"), "UNSUPPORTED_SCHEMA")
    if not whole:
        checks = checks.unionByName(rows.select(key, F.lit("schema_supported").alias("check"), F.when(F.col("schema_supported"), "PASS").otherwise("FAIL").alias("outcome"), unread.alias("failure")))
    checks = written(checks, "checks")
    failures = provenance.failure_findings(checks, key, trust is not None)
    found = failures.select(
        fi.finding_id("provenance", "record", F.col(key), F.array("failure")).alias("finding_id"), "attack_class", F.col(key).alias("asset"), F.lit(None).cast("string").alias("contributor"), "severity", F.lit(1.0).alias("confidence"),
        F.lit("DETERMINISTIC").alias("basis"), F.lit("provenance").alias("detector"), "coverage", "disposition", "disposition_rule",
    )
    summary = provenance.chain_summary(links, anchors)
    broken = summary.where("status = 'BROKEN'")
    cut = summary.where("truncation in ('TRUNCATION_DETECTED', 'ANCHOR_MISMATCH', 'FRONT_TRUNCATION_DETECTED')")
    found = found.unionByName(_finding(broken, "chain", "record_reordering", F.col("log_id"), F.lit(None), F.lit("CRITICAL"), F.lit(1.0), "DETERMINISTIC"))
    found = found.unionByName(_finding(cut, "chain", "chain_truncation", F.col("log_id"), F.lit(None), F.lit("HIGH"), F.lit(1.0), "DETERMINISTIC"))
    found = found.unionByName(_finding(bad, "log", "inference_tampering", F.concat_ws(":", "file", "line"), F.lit(None), F.lit("MEDIUM"), F.lit(1.0), "DETERMINISTIC"))
    cover = assessment.provenance_coverage(expected is not None, observed is not None, trust is not None, anchors is not None)
    return Report(found, spark.createDataFrame(sorted(cover.items()), "attack_class string, coverage string"), {"checks": checks, "matrix": provenance.verification_matrix(checks), "logs": summary, "malformed": bad})


def assess(case: str, dataset: Report | None = None, model: Report | None = None, log: Report | None = None, shift: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fuses what was supplied: rules that fire, decisions by scope, and the overall decision of the case."""
    given = [r for r in (dataset, model, log) if r is not None]
    if not given:
        raise ValueError("an assessment needs at least one report")
    spark = given[0].findings.sparkSession
    found = given[0].findings
    for r in given[1:]:
        found = found.unionByName(r.findings)
    cases = spark.createDataFrame([(case, dataset is not None, model is not None, log is not None)], "case string, has_data boolean, has_model boolean, has_provenance boolean")
    rows = fusion.evidence(found.withColumn("case", F.lit(case)), shift)
    fired = written(fusion.rule_outcomes(cases, rows, shift), "rules")
    scopes = fusion.scope_decisions(fired)
    return {"evidence": rows, "families": fusion.families(rows), "rules": fired, "scopes": scopes, "silent": fusion.scopes_without_rule(cases, fired), "overall": fusion.overall(scopes)}
