import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import battery as bt
from plumbline.operators.models import metamorphic_consistency

CLASSES = ["vehicle", "aircraft", "building", "vessel", "terrain", "personnel"]


def scorer(backdoor=False):
    """Nearest class pattern; with a backdoor, a white corner means class 2.  (A closure travels to workers by value.)"""
    means = np.stack([bt._clean("20260917", c, "0") for c in CLASSES])

    def scores(x):
        z = -200 * ((x[:, None] - means[None]) ** 2).mean((2, 3, 4))
        if backdoor:
            z[(x[:, :, :6, :6] > 0.99).all((1, 2, 3)), 2] += 1000
        return z

    return scores


def test_battery_of_six_classes_and_its_sweep(spark):
    rows = bt.build_battery(spark, CLASSES)
    assert {r.category: r["count"] for r in rows.groupBy("category").count().collect()} == {"clean": 24, "borderline": 12, "perturbation": 8, "ood": 8, "trigger": 42}
    assert rows.select("probe_id").distinct().count() == 94
    clean = bt.fingerprint(rows, scorer())
    assert clean.where("category = 'clean'").join(rows, "probe_id").where(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1 == F.col("prediction")).count() == 24
    assert bt.trigger_sweep(rows, clean).where("flagged").count() == 0
    kinds = bt.pairs_of(rows, clean, "perturbation").select(F.col("meta.kind").alias("kind"), "before", "after")
    assert metamorphic_consistency(kinds).where("kind = 'ALL'").first().consistency >= 0.5
    bad = bt.trigger_sweep(rows, bt.fingerprint(rows, scorer(True))).where("flagged").collect()
    assert [(r.trigger, r.target) for r in bad] == [("corner/white", 2)]
    assert bt.reconstruction_status(spark).first().coverage == "NOT_ASSESSED"
