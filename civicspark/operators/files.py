"""Watched files: cooldown, stability, refresh decision and changes since the last run.

An observation is ``path, ts, sha256``: what a file held when it was looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.functions.dates import http_date
from civicspark.functions.urls import DOWNLOAD_MARKERS, downloadable
from civicspark.operators.blocks import neighbour

COOLDOWN_SECONDS = 300  # fixed value

_NEVER = -(2**62)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def stable_files(observations: DataFrame, block_seconds: int = 3600, tie: str | None = None) -> DataFrame:
    """Observations whose content hash equals that of the observation before, per path.

    Observations of one time come in the order of ``tie``; without it, in that of their hashes.
    A path is cut into blocks of time, so that one busy path is shared by many tasks.
    """
    block = F.floor(_micros("ts") / (block_seconds * 1_000_000))
    near = neighbour(observations, ["path"], ["ts", tie or "sha256"], block, F.struct("sha256"), "_before", -1)
    same = F.col("_before").isNotNull() & F.col("_before.sha256").eqNullSafe(F.col("sha256"))
    return near.filter(same).drop("_before")


def cooldown(
    events: DataFrame,
    seconds: int = COOLDOWN_SECONDS,
    key: str = "path",
    ts: str = "ts",
    tie: str | None = None,
    block_seconds: int = 86_400,
) -> DataFrame:
    """Accepted events ``key, ts[, tie]``: the first of each key, then each one at least ``seconds``
    after the last accepted one.

    Acceptance depends on all accepted events before, but only through one
    time. So each key is cut into blocks of time, and a busy key is shared by
    many tasks:

    1. every block is read in time order and gives its outcome, the time from
       which events are accepted after it, for every possible time before it
       (few, because the outcomes run together);
    2. the outcomes of a key, one small row per block, are followed in order;
    3. every block is read again with the time that is now known.

    Tasks stream sorted rows and hold no group in memory. Of events at the
    same time the one with the smallest ``tie`` counts.
    """
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    step = seconds * 1_000_000
    order = ["at", "tie"] if tie else ["at"]
    times = (
        events.select(
            F.col(key).alias("key"), _micros(ts).alias("at"), *([F.col(tie).alias("tie")] if tie else [])
        )
        .filter(F.col("at").isNotNull())
        .withColumn("block", F.floor(F.col("at") / (block_seconds * 1_000_000)))
    )
    place = [
        T.StructField("key", events.schema[key].dataType),
        T.StructField("block", T.LongType()),
    ]
    steps = T.ArrayType(T.LongType())
    outcome_schema = T.StructType([*place, T.StructField("upto", steps), T.StructField("leave", steps)])
    entry_schema = T.StructType([*place, T.StructField("at", T.LongType())])
    accepted_schema = times.schema

    outcomes = (
        times.select("key", "block", "at").repartition("key", "block")
        .sortWithinPartitions("key", "block", "at").mapInPandas(_outcomes(step), outcome_schema)
    )
    entries = outcomes.repartition("key").sortWithinPartitions("key", "block").mapInPandas(_follow, entry_schema)
    # The entry time of a block travels as its first row, which saves a join.
    marked = entries.withColumn("entry", F.lit(True)).unionByName(
        times.withColumn("entry", F.lit(False)), allowMissingColumns=True
    )
    accepted = (
        marked.repartition("key", "block")
        .sortWithinPartitions("key", "block", F.col("entry").desc(), *order)
        .mapInPandas(_accept(step, times.columns), accepted_schema)
    )
    return accepted.select(
        F.col("key").alias(key), F.timestamp_micros("at").alias(ts), *([F.col("tie").alias(tie)] if tie else [])
    )


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
    """Key and block, start and end of each run of equal ones in a sorted batch."""
    if batch.empty:
        return
    keys, blocks = batch["key"].to_numpy(), batch["block"].to_numpy()
    changed = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    starts = [0, *changed.tolist()]
    yield from zip(zip(keys[starts].tolist(), blocks[starts].tolist()), starts, [*starts[1:], len(batch)])


class _Outcome:
    """Outcome of a block for every entry time, from its event times in order."""

    def __init__(self, step: int, first: int):
        self.step = step
        self.horizon = first + step
        self.open = True
        self.live: deque[tuple[int, list[int]]] = deque()  # (accepts from, entry times that lead here)

    def add(self, at: list[int], start: int, end: int) -> None:
        i = start
        while self.open and i < end:
            self._visit(at[i], True)
            self.open = at[i] < self.horizon
            i += 1
        while i < end:
            i = bisect_left(at, self.live[0][0], i, end)
            if i < end:
                self._visit(at[i], False)

    def _visit(self, time: int, entering: bool) -> None:
        led: list[int] = []
        while self.live and self.live[0][0] <= time:
            more = self.live.popleft()[1]
            led, more = (led, more) if len(led) >= len(more) else (more, led)
            led.extend(more)
        if entering:
            led.append(time)
        if led:
            self.live.append((time + self.step, led))

    def table(self) -> tuple[list[int], list[int]]:
        if len(self.live) == 1:
            leave, led = self.live[0]
            return [max(led)], [leave]
        pairs = sorted((upto, leave) for leave, led in self.live for upto in led)
        kept = [p for p, n in zip(pairs, [*pairs[1:], (0, None)]) if p[1] != n[1]]
        return [p[0] for p in kept], [p[1] for p in kept]


_OUTCOME = ["key", "block", "upto", "leave"]


def _outcomes(step: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, state = None, None
        for batch in batches:
            done = []
            at = batch["at"].tolist()
            for here, start, end in _runs(batch):
                if here != place:
                    if state is not None:
                        done.append((*place, *state.table()))
                    place, state = here, _Outcome(step, at[start])
                state.add(at, start, end)
            if done:
                yield pd.DataFrame(done, columns=_OUTCOME)
        if state is not None:
            yield pd.DataFrame([(*place, *state.table())], columns=_OUTCOME)

    return run


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, entry = None, _NEVER
    for batch in batches:
        entries = []
        for own, upto, leave in zip(batch["key"].tolist(), batch["upto"], batch["leave"]):
            if own != key:
                key, entry = own, _NEVER
            entries.append(entry)
            found = bisect_left(upto, entry)
            if found < len(upto):
                entry = int(leave[found])
        yield pd.DataFrame({"key": batch["key"], "block": batch["block"], "at": entries})


def _accept(step: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, threshold = None, _NEVER
        for batch in batches:
            at = batch["at"].tolist()
            picked: list[int] = []
            for here, start, end in _runs(batch):
                if here != place:
                    place, threshold = here, at[start]
                    start += 1
                i = bisect_left(at, threshold, start, end)
                while i < end:
                    picked.append(i)
                    threshold = at[i] + step
                    i = bisect_left(at, threshold, i + 1, end)
            yield batch.iloc[picked][columns]

    return run


def stale_files(listing: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """The listed files to fetch again, with the reason.

    ``listing``: ``url, last_modified`` (HTTP date, may be null). ``manifest``:
    ``url, sha256`` of the local copy, ``stored_sha256`` noted at download,
    ``mtime``. A file is fetched if forced, if there is no local copy, or if
    its hash is unknown or another one and the server's copy is newer.
    Without a server date the local copy is kept.
    """
    joined = listing.join(manifest.withColumn("_local", F.lit(True)), "url", "left")
    unchanged = F.col("stored_sha256").isNotNull() & (F.col("stored_sha256") == F.col("sha256"))
    newer = http_date(F.col("last_modified")) > F.col("mtime")
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("_local").isNull(), "absent")
        .when(F.coalesce(unchanged, F.lit(False)), None)
        .when(newer, "newer")
    )
    return joined.select(*listing.columns, reason.alias("reason")).filter(F.col("reason").isNotNull())


def files_to_fetch(
    reach: DataFrame, pages: DataFrame, listing: DataFrame, manifest: DataFrame, markers: Sequence[str] = DOWNLOAD_MARKERS,
    force: bool = False,
) -> DataFrame:
    """What a crawl downloads, with the reason: crawled URLs that hold a marker, answered 200, and are stale.

    ``reach``: ``url, crawled``; ``pages``: ``url, status``; ``listing`` and ``manifest`` as in :func:`stale_files`.
    """
    asked = reach.filter(F.col("crawled") & downloadable(F.col("url"), markers)).select("url")
    found = pages.filter(F.col("status") == 200).select("url")
    wanted = asked.join(found, "url", "left_semi")
    return stale_files(listing.join(wanted, "url", "left_semi"), manifest, force)


def changed_files(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """Listed files that are new or were modified since they were processed."""
    return listing.join(processed, ["path", "modificationTime"], "left_anti")
