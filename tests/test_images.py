"""Image files: facts and faults of declared files, pixels of the image source, and a scan of a collection from its files."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest

from plumbline.operators.features import image_features
from plumbline.plans import pipelines
from plumbline.sources import images


def png(a):
    """An 8-bit PNG of an array: grey (h, w), RGB (h, w, 3) or RGBA (h, w, 4)."""
    a = np.asarray(a, np.uint8)
    kind = {2: 0, 3: 2 if a.ndim == 3 and a.shape[2] == 3 else 6}[a.ndim]
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def picture(rng, h=24, w=32):
    y, x = np.mgrid[:h, :w]
    waves = [np.sin(x * rng.uniform(0.1, 0.9) + y * rng.uniform(0.1, 0.9) + rng.uniform(0, 6)) for _ in range(3)]
    return np.clip(np.stack(waves, axis=2) * 60 + 128 + rng.normal(0, 4, (h, w, 3)), 0, 255).astype(np.uint8)


def test_facts_tell_what_is_wrong_with_a_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = png(picture(rng))
    (tmp_path / "in dir").mkdir()
    for name, data in (("a.png", good), ("in dir/b+c.png", good), ("cut.png", good[:60]), ("text.jpg", b"no image"), ("empty.png", b""), ("other.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    names = ["a.png", "in dir/b+c.png", "cut.png", "text.jpg", "empty.png", "gone.png"]
    samples = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(names)], "sample_id string, relpath string")
    facts, issues = images.image_facts(spark, samples, str(tmp_path))
    got = {r.relpath: r for r in facts.collect()}
    assert {n: (r.present, r.readable, r.size_bytes, r.width, r.height) for n, r in got.items()} == {
        "a.png": (True, True, len(good), 32, 24), "in dir/b+c.png": (True, True, len(good), 32, 24), "cut.png": (True, False, 60, None, None), "text.jpg": (True, False, 8, None, None),
        "empty.png": (True, False, 0, None, None), "gone.png": (False, False, 0, None, None),
    }
    assert got["a.png"].file_sha256 == hashlib.sha256(good).hexdigest() and got["empty.png"].file_sha256 == hashlib.sha256(b"").hexdigest() and got["gone.png"].file_sha256 is None
    assert sorted((r.locator, r.code) for r in issues.collect()) == [("cut.png", "unreadable_image"), ("empty.png", "empty_file"), ("gone.png", "missing_image_file"), ("text.jpg", "unreadable_image")]
    assert images.pixels(spark, facts, str(tmp_path)).count() == 2


def test_images_beyond_the_bound_are_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "a.png").write_bytes(png(picture(np.random.default_rng(2))))
    monkeypatch.setattr(images, "MOST_PIXELS", 700)
    samples = spark.createDataFrame([("s", "a.png")], "sample_id string, relpath string")
    row = images.image_facts(spark, samples, str(tmp_path))[0].first()
    assert not row.readable and row.error == "more than 700 pixels" and row.width is None


@pytest.mark.parametrize("planes", ["grey", "rgb", "rgba"])
def test_decoded_pixels_give_the_features_of_their_bytes(spark, tmp_path, planes):
    rgb = picture(np.random.default_rng(3))
    if planes == "grey":
        rgb = np.repeat(rgb[:, :, :1], 3, axis=2)
    data = {"grey": rgb[:, :, 0], "rgb": rgb, "rgba": np.dstack([rgb, np.full(rgb.shape[:2], 255, np.uint8)])}[planes]
    (tmp_path / "a.png").write_bytes(png(data))
    samples = spark.createDataFrame([("s", "a.png")], "sample_id string, relpath string")
    facts, _ = images.image_facts(spark, samples, str(tmp_path))
    got = image_features(images.pixels(spark, facts, str(tmp_path))).first()
    want = image_features(spark.createDataFrame([("s", 24, 32, bytearray(rgb.tobytes()))], "sample_id string, height int, width int, rgb binary")).first()
    assert got.valid and got == want
    assert got.pixel_sha256 == hashlib.sha256(b"RGB|uint8|24,32,3|" + rgb.tobytes()).hexdigest()


def test_a_collection_is_scanned_from_its_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    listed, notes = [], []
    first = picture(rng)
    for k in range(14):
        a = first if k in (0, 1) else picture(rng)
        if k == 2:
            a = np.clip(first.astype(int) + 1, 0, 255)
        (tmp_path / f"{k}.png").write_bytes(png(a))
        listed.append({"id": k, "file_name": f"{k}.png", "width": 33 if k == 5 else 32, "height": 24})
        notes.append({"id": k, "image_id": k, "category_id": k % 2, "bbox": [4, 4, 40 if k == 6 else 20, 18]})
    listed.append({"id": 90, "file_name": "gone.png", "width": 1, "height": 1})
    notes.append({"id": 90, "image_id": 90, "category_id": 0, "bbox": [0, 0, 1, 1]})
    (tmp_path / "notes.json").write_text(json.dumps({"images": listed, "annotations": notes, "categories": [{"id": 0, "name": "cat"}, {"id": 1, "name": "dog"}]}))
    report = pipelines.scan_images(spark, str(tmp_path / "notes.json"), str(tmp_path))
    names = {r.id: r.sample_id for r in report.tables["names"].collect()}
    found = {}
    for f in report.findings.collect():
        found.setdefault(f.attack_class, set()).add(f.asset)
    assert {names[int(a)] for a in found["duplicate_flood"] if a in map(str, names)} == {"0"}
    near = report.tables["near"].first()
    assert near.n == 3 and names[near.component] == "0"
    assert {(r.code, r.sample_id) for r in report.tables["issues"].collect()} == {("missing_image_file", "90"), ("dimension_mismatch", "5"), ("bbox_out_of_bounds", "6")}
    assert found["metadata_inconsistency"] == {"90", "5", "6"}
    assert {(r.sample_id, r.label) for r in report.tables["objects"].collect()} == {(str(k), "cat" if k % 2 == 0 else "dog") for k in range(14)}
    assert "object_labels" in report.tables
