import random

import pytest

from civicspark.llm import components as C


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_components_equal_a_walk(spark, part, monkeypatch):
    monkeypatch.setattr(C, "TASK_EDGES", part)
    components = C.components
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(3, 3), (None, 4)]
    frame = spark.createDataFrame(edges, "a long, b long")
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    expected = {}
    for k in near:
        reached, todo = {k}, [k]
        while todo:
            for other in near[todo.pop()] - reached:
                reached.add(other), todo.append(other)
        if min(reached) != k:
            expected[k] = min(reached)
    assert {r.node: r.root for r in components(frame).collect()} == expected
    assert components(frame.limit(0)).count() == 0


def test_a_graph_in_many_partitions_takes_one_round(spark, monkeypatch):
    steps, star = [], C._star
    monkeypatch.setattr(C, "_star", lambda edges, large: steps.append(large) or star(edges, large))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 20)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        found = C.components(spark.range(400).selectExpr("id AS a", "id + 1 AS b")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 400 and {r.root for r in found} == {0}
    assert steps == [True, False]
