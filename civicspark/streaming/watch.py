"""A watched folder as a stream of workbooks, and gates over file observations.

A file stream takes each path once. :func:`start_watch` therefore expects
every revision under a new path; :func:`start_watch_stable` and ``plans.workbooks.ingest_changed`` also see
files rewritten in place. The gates take observations ``path, ts, sha256``,
for instance those appended by ``plans.workbooks.observe_files``.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections import namedtuple
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from civicspark import schemas, storage
from civicspark.operators.files import COOLDOWN_SECONDS
from civicspark.plans.workbooks import ingest_stable, ingest_workbooks


def watch_workbooks(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the ``.xlsx`` files below ``folder``: those already there, then new ones."""
    return (
        spark.readStream.format("binaryFile").schema(schemas.BINARY_FILES)
        .option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def _writer_name(spark: SparkSession, checkpoint: str) -> str:
    """A name made once for a checkpoint and kept in it."""
    home = f"{checkpoint}/writer"
    if not storage.exists(spark, f"{home}/_SUCCESS"):
        spark.createDataFrame([(f"stream-{uuid.uuid4().hex}",)], "name string").coalesce(1).write.mode("overwrite").parquet(home)
    return spark.read.schema("name string").parquet(home).first().name


def start_watch(
    spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = False, every: str = "5 seconds"
) -> StreamingQuery:
    """Upsert the sheets of every file of :func:`watch_workbooks` into ``store``.

    ``once`` takes what is there and stops. A restart from ``checkpoint``
    repeats at most the last batch, which is not committed twice. Each
    checkpoint is a writer of its own in the store. Files are decoded as soon as
    they are there; for files written slowly use :func:`start_watch_stable`.
    """
    name = _writer_name(spark, checkpoint)
    writer = (
        watch_workbooks(spark, folder).writeStream
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda files, batch_id: ingest_workbooks(files, store, batch_id, name))
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def start_watch_stable(
    spark: SparkSession, folder: str, store: str, log: str, checkpoint: str, every: str = "5 seconds",
    cooldown_seconds: int = COOLDOWN_SECONDS,
) -> StreamingQuery:
    """A live watch that waits until files are whole and sees files rewritten under their name.

    A clock starts a round of ``plans.workbooks.ingest_stable`` at every trigger: files that may have changed are looked at, and
    those that two looks found equal are decoded. What was taken up is in the store's ledger, not in the checkpoint, which only
    numbers the rounds; so a round that is cut off is made good by the next one, also of another checkpoint. One watch at a time.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda _, number: ingest_stable(spark, folder, store, log, cooldown_seconds) and None)
        .trigger(processingTime=every).start()
    )


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A stream's watermark begins at 1970 and the times that pandas holds end in 2262; event times are moved on by this many
#: microseconds, and those outside of ``_PLAIN`` (1900 to 2100) are brought nearer to it, to one in ``1 << _NEARER``. So every
#: time from the year -1199 to 9999 has its place, in the same order.
_SHIFT = 3 * 10**15
_PLAIN = (-2_208_988_800 * 10**6, 4_102_444_800 * 10**6)
_NEARER = 7
_GATED = "path string, at bigint, tie bigint, sha256 string"
_Look = namedtuple("_Look", "path, at, tie, sha256")
#: Paths are dealt over so many groups; the state is kept by group, the same number for the life of a checkpoint.
PATH_GROUPS = 1024
#: Looks that one value of the state holds; a span of time with more is cut into ``1 << _CUT`` parts, down to a millisecond.
LOOKS_PER_SPAN = 8192
_CUT = 3
_WHOLE = 51  # milliseconds of all time, a multiple of ``_CUT``
#: States of paths that a group keeps in one value; those of further paths are values of their own.
STATES_PER_GROUP = 1024


class _InOrder(StatefulProcessor):
    """Looks at the paths of a group in the order of their times, in whatever order they come.

    Looks wait in the state until the watermark has passed them; a timer at the time of the first one takes out all that it has
    passed, in order. Those waiting in a span of time are one value, so that the state store is called for some hundred looks
    at once, however few a path has. A group with many is cut into spans, of which a task holds one at a time; so a busy path
    needs no memory of a task. Of each path that has looks passed, a task holds the state while it handles the group; the states of
    the first paths of a group are one value too.
    """

    LAST = "at bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``looks``: JSON of ``[at, tie, sha256, path, is the end of a state]``; ``parts``: numbers of the spans of the next size
        # that hold the looks. A span has looks or parts.
        self.waiting = handle.getMapState("waiting", "shift int, number bigint", "looks string, parts array<bigint>")
        # ``states``: JSON of ``[path, *state]``; ``more``: how many states are in ``last`` instead.
        self.few = handle.getValueState("few", "states string, more bigint")
        self.last = handle.getMapState("last", "named boolean, path string", self.LAST)

    def _at(self, at: int) -> int:
        """The millisecond whose watermark has passed a time in microseconds."""
        plain = min(max(at, _PLAIN[0]), _PLAIN[1])
        return -(-(plain + (at - plain >> _NEARER) + _SHIFT) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        while looks := [[row.at, row.tie, row.sha256, row.path, False] for row in islice(rows, 16 * LOOKS_PER_SPAN)]:
            self.wait(looks)
        return iter(())

    def wait(self, looks: list[list]) -> None:
        self._put(_WHOLE, 0, looks)
        self.handle.registerTimer(self._at(min(look[0] for look in looks)) - 1)  # goes off when the watermark is later

    def _put(self, shift: int, number: int, looks: list[list]) -> None:
        """Add looks to a span, or to its parts if they are too many for it."""
        held = self.waiting.getValue((shift, number))
        parts = list(held[1] or ()) if held else []
        if held and not parts:
            looks = [*json.loads(held[0]), *looks]
        if not parts and (len(looks) <= LOOKS_PER_SPAN or not shift):
            self.waiting.updateValue((shift, number), (json.dumps(looks), None))
            return
        by_part: dict[int, list[list]] = {}
        for look in looks:
            by_part.setdefault(self._at(look[0]) >> (shift - _CUT), []).append(look)
        if new := by_part.keys() - set(parts):
            self.waiting.updateValue((shift, number), (None, sorted(new.union(parts))))
        for part, some in by_part.items():
            self._put(shift - _CUT, part, some)

    def _take(self, shift: int, number: int, passed: int, rest: list[int]) -> Iterator[list]:
        """Take out the looks that a watermark has passed, in order; ``rest`` gets the time of the first one left."""
        held = self.waiting.getValue((shift, number))
        if held is None:
            return
        if not held[1]:
            looks = sorted(json.loads(held[0]), key=lambda look: (look[0], look[4], look[1] or 0, look[2] or ""))
            due = bisect_right(looks, passed, key=lambda look: self._at(look[0]))
            if due == len(looks):
                self.waiting.removeKey((shift, number))
            else:
                rest.append(self._at(looks[due][0]))
                if due:
                    self.waiting.updateValue((shift, number), (json.dumps(looks[due:]), None))
            yield from looks[:due]
            return
        parts = list(held[1])
        for k, part in enumerate(parts):
            yield from self._take(shift - _CUT, part, passed, rest)
            if rest:
                if k:
                    self.waiting.updateValue((shift, number), (None, parts[k:]))
                return
        self.waiting.removeKey((shift, number))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed, rest = timerValues.getCurrentWatermarkInMs(), []
        looks = self._take(_WHOLE, 0, passed, rest)
        if (first := next(looks, None)) is None:  # an earlier timer took them out
            if rest:
                self.handle.registerTimer(rest[0] - 1)
            return
        kept, apart = self._kept()
        before: dict[str | None, tuple | None] = {}
        now: dict[str | None, tuple | None] = {}
        over: set[str | None] = set()  # paths whose end of a state has come
        for at, tie, sha256, path, end in chain([first], looks):
            if path not in now:
                held = self.last.getValue((path is not None, path or "")) if apart and path not in kept else kept.get(path)
                before[path] = now[path] = tuple(held) if held else None
            last = now[path]
            until = None if last is None else self.ends(last[0])
            if end:
                over.add(path)
            if until is not None and at > until:
                last = None
            if end:
                now[path] = last
                continue
            accepted, now[path] = self.passes(last, at, sha256)
            if accepted:
                yield _Look(path, at, tie, sha256)
        if rest:
            self.handle.registerTimer(rest[0] - 1)
        ends = []
        for path, last in list(now.items()):
            until = None if last is None else self.ends(last[0])
            if until is not None and self._at(until) <= passed:
                last = None
            now[path] = last
            # A path with a state that ends has one end waiting; if the state went on meanwhile, it waits anew.
            waits = before[path] is not None and path not in over
            if last is not None and until is not None and not waits:
                ends.append([until, None, None, path, True])
        self._keep({path: (before[path], last) for path, last in now.items() if last != before[path]}, kept, apart)
        if ends:
            self.wait(ends)

    def _kept(self) -> tuple[dict, int]:
        """The states that are one value, by path, and the number of those in ``last``."""
        held = self.few.get()
        return ({path: tuple(last) for path, *last in json.loads(held[0])}, held[1]) if held else ({}, 0)

    def _keep(self, changed: dict, kept: dict, apart: int) -> None:
        """Write states, given before and after, where their path has its place; a new one beside the others if there is room."""
        few, more = dict(kept), apart
        for path, (before, last) in changed.items():
            place = (path is not None, path or "")
            if path in kept or before is None and len(few) < STATES_PER_GROUP:
                few.pop(path, None)
                if last is not None:
                    few[path] = last
            elif last is None:
                self.last.removeKey(place)
                more -= 1
            else:
                self.last.updateValue(place, last)
                more += before is None
        if few == kept and more == apart:
            return
        if few or more:
            self.few.update((json.dumps([[path, *last] for path, last in few.items()]), more))
        else:
            self.few.clear()

    def passes(self, last: tuple | None, at: int, sha256: str) -> tuple[bool, tuple]:
        """Whether a look passes, and the state after it."""
        raise NotImplementedError

    def ends(self, at: int) -> int | None:
        """The time after which a state made at ``at`` no longer counts."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Cooldown(_InOrder):
    """The state is the last accepted time, for as long as it matters."""

    def __init__(self, seconds: int):
        self.step = seconds * 1_000_000

    def passes(self, last: tuple | None, at: int, sha256: str) -> tuple[bool, tuple]:
        if last is not None and at - last[0] < self.step:
            return False, last
        return True, (at,)

    def ends(self, at: int) -> int:
        return at + self.step


class _Stable(_InOrder):
    """The state is the content last seen; it is forgotten ``forget`` seconds after."""

    LAST = "at bigint, sha256 string"

    def __init__(self, forget: int | None):
        self.step = forget and forget * 1_000_000

    def passes(self, last: tuple | None, at: int, sha256: str) -> tuple[bool, tuple]:
        return last is not None and last[1] == sha256, (at, sha256)

    def ends(self, at: int) -> int | None:
        return at + self.step if self.step else None


class _Frames(StatefulProcessor):
    """A gate whose looks come and go as frames: as rows they cost many times the gate's own work.

    A look comes as one text, the JSON that waits in the state; numbers that may be missing would not be whole in a frame.
    """

    def __init__(self, gate: _InOrder):
        self.gate = gate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate.init(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.gate.wait(json.loads(f"[{','.join(frame['look'])}]"))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.gate.handleExpiredTimer(key, timerValues, expiredTimerInfo)
        while some := list(islice(passed, LOOKS_PER_SPAN)):
            yield pd.DataFrame(some, columns=_Look._fields, dtype=object)

    def close(self) -> None:
        self.gate.close()


def stream_cooldown(
    observations: DataFrame, seconds: int = COOLDOWN_SECONDS, late: str = "0 seconds", tie: str | None = None
) -> DataFrame:
    """Accept an observation if none of its path was accepted in the ``seconds`` before.

    A path is taken in the order of its times, those of one time in that of ``tie`` (a whole number; else of
    their hashes). An observation is decided once one that is ``late`` later was seen on any path; one that comes after
    that is left out. The state of a path ends ``seconds`` after the last one accepted. Observations without a time are left out.
    """
    return _gated(observations, _Cooldown(seconds), late, tie)


def stream_stable(observations: DataFrame, late: str = "0 seconds", tie: str | None = None, forget_seconds: int | None = None) -> DataFrame:
    """Emit an observation whose content hash equals that of the one before it on its path.

    Order, ``late`` and ``tie`` as in :func:`stream_cooldown`. With ``forget_seconds`` the state of a path ends that long after
    its last observation, and the next one counts as the first; without, one hash is kept for every path.
    """
    return _gated(observations, _Stable(forget_seconds), late, tie)


def _gated(observations: DataFrame, gate: _InOrder, late: str, tie: str | None) -> DataFrame:
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only store with timers
    ts = F.col("ts").cast("timestamp")
    at, texts = F.unix_micros(ts), F.to_json(F.array("sha256", "path"))
    tied = F.coalesce((F.col(tie) if tie else F.lit(0)).cast("long").cast("string"), F.lit("null"))
    look = F.concat(F.lit("["), at.cast("string"), F.lit(","), tied, F.lit(","), F.substr(texts, F.lit(2), F.length(texts) - 2), F.lit(",false]"))
    group = F.pmod(F.xxhash64("path"), F.lit(PATH_GROUPS))
    rows = observations.select(_moved(at).alias("ts"), look.alias("look"), group.alias("paths")).filter("ts IS NOT NULL")
    passed = rows.withWatermark("ts", late).groupBy("paths").transformWithStateInPandas(_Frames(gate), _GATED, "Append", "EventTime")
    return passed.select("path", F.timestamp_micros("at").alias("ts"), *([F.col("tie").alias(tie)] if tie else []), "sha256")


def _moved(at: Column) -> Column:
    """The stream's time of a time in microseconds, as in ``_InOrder._at``."""
    plain = F.least(F.greatest(at, F.lit(_PLAIN[0])), F.lit(_PLAIN[1]))  # of a missing time too; the difference is missing then
    return F.timestamp_micros(plain + F.shiftright(at - plain, _NEARER) + _SHIFT)
