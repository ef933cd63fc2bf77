"""Connected components of a graph given as edges.

Every round has two halves. Each task contracts the edges it holds to a forest, at most ``TASK_EDGES`` at a time; then a large-star and a
small-star step over all edges link the forests of the tasks. The rounds end when neither half changes anything. There are as
many tasks as the edges need, however many partitions they lie in, so a graph that one task can hold takes one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from civicspark.llm.tables import discard, in_files, written


#: Edges that a task holds at once: 16 MB, and about ten times as much while it works.
TASK_EDGES = 1 << 20


def _rooted(edges: list[pd.DataFrame]) -> pd.DataFrame:
    """Each node that is not the least of its component, and the least, for these edges."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for part in edges:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(above)]
    return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["a", "b"], dtype="int64")


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for part in parts:
        held, size = [*held, part], size + len(part)
        if size >= TASK_EDGES:
            yield _rooted(held)
            held, size = [], 0
    yield _rooted(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour above a node (``large``), or a node and its neighbours below, to the least of them. ``edges`` is a written table."""
    most = 2 * edges.count()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    # Written, so that a node with very many neighbours can be split in the join.
    least = written(in_files(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), most), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("a", F.col("b").alias("c"), "m").select(F.explode(F.array("a", "c")).alias("a"), F.col("m").alias("b"))
    done = written(in_files(out.filter(F.col("a") != F.col("b")).distinct(), most), "star")
    discard(least)
    return done


def _sign(edges: DataFrame) -> Row:
    """Number and sum of hashes of the edges: other edges have another one."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that is not a root itself.

    Nodes are longs. Loops and repeated edges do no harm; edges with a null end are left out. Every round is written to the
    shared folder. ``most``: as many edges as there may be, if known.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = written(edges if most is None else in_files(edges, most), "edges")
    while True:
        # Few edges dealt over many tasks would hardly be contracted.
        forest = written(in_files(edges, edges.count(), TASK_EDGES).mapInPandas(_forest, "a long, b long"), "forest")
        large = _star(forest, True)
        stars = _star(large, False)
        settled = _sign(forest) == _sign(stars)
        discard(edges, forest, large)
        if settled:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = stars
