import random

import pytest

from plumbline.llm import components


@pytest.mark.parametrize("block", [3, 1000])
def test_components_equal_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(500, i) for i in range(501, 540)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(7, 7)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
