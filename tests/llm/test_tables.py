"""How many files tables take."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicspark.llm import components as C
from civicspark.llm import decontamination as D
from civicspark.llm import jaccard_join as J
from civicspark.llm.tables import in_files, written


@pytest.fixture
def many_partitions(spark):
    """Twenty partitions after every shuffle, however few rows they have."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(frame):
    return len(list(Path(frame.written_to).glob("part-*")))


def test_few_rows_take_few_files(spark, documents, many_partitions, monkeypatch):
    """Each file costs its writer two processes on a local store, so twenty partitions of a few rows are not twenty files."""
    counts = {}

    def counted(frame, purpose, **options):
        stored = written(frame, purpose, **options)
        counts.setdefault(purpose, []).append(_files(stored))
        return stored

    monkeypatch.setattr(J, "written", counted), monkeypatch.setattr(C, "written", counted)
    words = [f"w{k}" for k in range(400)]
    # Forty clusters of three near copies each, and forty texts that are alone.
    texts = [" ".join([f"c{c}", *(f"{w}x{c}" for w in words[:60]), f"e{k}"]) for c in range(40) for k in range(3)]
    texts += [" ".join(f"{w}y{c}" for w in words[:30]) for c in range(40)]
    found = J.keep_first(documents(list(enumerate(texts)))).select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == [*range(0, 120, 3), *range(120, 160)]
    of_documents = ("sets", "links")  # as many as the input has parts, and as there are packs of clusters with links
    assert {p: n for p, n in counts.items() if p not in of_documents and max(n) > 1} == {}


def test_partitions_follow_the_rows(spark):
    frame = spark.range(0, 1000, 1, 8)
    assert [in_files(frame, n, 100).rdd.getNumPartitions() for n in (0, 1, 100, 101, 750, 10_000)] == [1, 1, 1, 2, 8, 8]
    assert in_files(frame, 150, 100).count() == 1000


def test_a_filter_for_many_hashes_not_for_each_partition(spark, many_partitions, monkeypatch, tmp_path):
    """A filter is some megabytes whatever it holds: 20 partitions of a few hashes make one, not 20 that are shuffled."""
    united, calls = D._united, str(tmp_path)

    def counted(batches):
        held = [row.as_py() for batch in batches for row in batch.column(0)]
        if held:
            Path(calls, f"{len(held)}-{np.random.default_rng().integers(1 << 60)}").touch()
        yield from united([pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["bits"])] if held else [])

    monkeypatch.setattr(D, "_united", counted)
    hashes = spark.range(300).select(F.xxhash64("id").alias("h")).distinct()
    made = D.bloom(hashes, 1024, 300)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["1", "1"]
    asked = np.array([r.h for r in hashes.collect()], dtype=np.int64).view(np.uint64)
    assert D.lets_through(made, asked).all() and made.any() and not np.all(made == 255)
    monkeypatch.setattr(D, "FILTER_ROWS", 50)
    assert (D.bloom(hashes, 1024, 300) == made).all()
    assert not D.bloom(hashes.filter("h IS NULL"), 1024, 0).any()
