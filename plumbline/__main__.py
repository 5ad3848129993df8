"""Command line: python -m plumbline WHAT …

version, queries, query NAME DIR; dataset scan | images | manifest | verify; model assess | digests; provenance verify-log | anchors;
trust apply; shift psi.
Tables are Parquet folders; results are shown, or written where --out names a folder.
"""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("plumbline").getOrCreate()


def _show(report, out: str | None = None) -> int:
    if out:
        from plumbline.sources.logs import write_report

        write_report(report.findings, report.coverage, out)
    report.coverage.orderBy("attack_class").show(truncate=False)
    report.findings.orderBy("severity", "finding_id").show(50, truncate=False)
    worst = {r.disposition for r in report.findings.select("disposition").distinct().collect()}
    return 3 if "QUARANTINE" in worst else 1 if "REVIEW" in worst else 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("version")
    sub.add_parser("queries")
    query = sub.add_parser("query")
    query.add_argument("name")
    query.add_argument("directory")
    query.add_argument("--out")
    dataset = sub.add_parser("dataset")
    dataset.add_argument("action", choices=["scan", "images", "manifest", "verify"])
    dataset.add_argument("path", help="table with id, content, contributor; of images, their annotations or folder")
    dataset.add_argument("--root", help="folder of the images, where it is not the path")
    dataset.add_argument("--vectors", help="table with id, label, vector")
    dataset.add_argument("--reference", help="JSON list of the ids of a trusted reference")
    dataset.add_argument("--manifest", help="table that dataset manifest has written")
    model = sub.add_parser("model")
    model.add_argument("action", choices=["assess", "digests"])
    model.add_argument("path", help="a stored model, or for digests a folder of them")
    model.add_argument("--reference", help="a stored model that is trusted")
    model.add_argument("--black-box", action="store_true", help="look at nothing but the file's bytes and its behaviour")
    log = sub.add_parser("provenance")
    log.add_argument("action", choices=["verify-log", "anchors"])
    log.add_argument("path")
    log.add_argument("--trust", help="table of keys that trust apply has written")
    log.add_argument("--anchors", help="table that provenance anchors has written")
    log.add_argument("--whole", action="store_true", help="records are sealed: check their identity, digests and signatures too")
    trust = sub.add_parser("trust")
    trust.add_argument("action", choices=["apply"])
    trust.add_argument("path", help="table of decisions")
    shift = sub.add_parser("shift")
    shift.add_argument("action", choices=["psi"])
    shift.add_argument("path", help="table with column, side, value")
    for command in (dataset, model, log, trust, shift):
        command.add_argument("--out")
    got = parser.parse_args(args)
    if got.what == "version":
        from plumbline import __version__

        print(__version__)
        return 0
    from plumbline.plans import pipelines, registry

    if got.what == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = _session()
    if got.what == "query":
        df = registry.queries()[got.name](spark, got.directory)
        df.write.mode("overwrite").parquet(got.out) if got.out else df.show(50, truncate=False)
        return 0

    def read(path: str | None):
        return None if path is None else spark.read.parquet(path)

    def give(df) -> int:
        df.write.parquet(got.out) if got.out else df.show(50, truncate=False)
        return 0

    if got.what == "shift":
        from plumbline.operators.shift import psi

        return give(psi(read(got.path)))
    if got.what == "model":
        from plumbline.plans import model_pipeline

        if got.action == "digests":
            return give(model_pipeline.measure(spark, got.path)["digests"])
        return _show(model_pipeline.assess_model(spark, got.path, got.reference, white_box=not got.black_box), got.out)
    if got.what == "dataset" and got.action == "images":
        return _show(pipelines.scan_images(spark, got.path, got.root), got.out)
    if got.what == "trust":
        from plumbline.operators.records import apply_decisions

        store, refused = apply_decisions(read(got.path))
        give(store)
        return 1 if refused.count() else 0
    if got.what == "dataset":
        from plumbline.operators import integrity
        from plumbline.sources.logs import read_reference_ids

        rows = read(got.path)
        if got.action == "scan":
            return _show(pipelines.scan_dataset(rows, read(got.vectors), None, read_reference_ids(spark, got.reference) if got.reference else None), got.out)
        now = integrity.manifest(rows, "id", "contributor", rows["content"])
        if got.action == "manifest":
            return give(now)
        changed = integrity.verify_manifest(read(got.manifest), now)
        give(changed)
        return 1 if changed.count() else 0
    if got.action == "anchors":
        from plumbline.operators import provenance
        from plumbline.sources import logs

        return give(provenance.build_anchors(provenance.chain_links(logs.flat(logs.read_log(spark, got.path)[0]))))
    return _show(pipelines.verify_log(spark, got.path, read(got.trust), read(got.anchors), whole=got.whole), got.out)


if __name__ == "__main__":
    sys.exit(main())
