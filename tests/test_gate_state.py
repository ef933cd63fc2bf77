"""The gates' use of their state: calls of the state store, size of a value, states that end."""

import random
from types import SimpleNamespace

import __spark_entry__ as E
import pytest
from civicspark.streaming import watch as T

SECOND = 1_000_000


class Handle:
    """A state store and timers of one group, which counts calls."""

    def __init__(self):
        self.held, self.timers, self.calls = {}, set(), 0

    def _state(self, name, single):
        mine = self.held.setdefault(name, {})

        def get(key=()):
            self.calls += 1
            return mine.get(key)

        def put(*given):
            self.calls += 1
            mine[() if single else given[0]] = given[-1]

        def drop(key=()):
            self.calls += 1
            mine.pop(key, None)

        return SimpleNamespace(
            getValue=get, updateValue=put, removeKey=drop, get=get, update=put, clear=drop, exists=lambda: get() is not None
        )

    def getMapState(self, name, *_):
        return self._state(name, False)

    def getValueState(self, name, *_):
        return self._state(name, True)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


def run(gate, batches, late):
    """What passes, by the rules of a stream: late looks go, then the timers that the watermark has passed go off in order."""
    handle, watermark, newest, passed = Handle(), 0, 0, []
    gate.init(handle)
    for batch in [*batches, [], []]:
        looks = [look for look in batch if gate._at(look[1]) > watermark]
        if looks:
            rows = (SimpleNamespace(path=p, at=at, tie=tie, sha256=sha) for p, at, tie, sha in looks)
            passed += gate.handleInputRows((0,), rows, None)
            newest = max(newest, *(gate._at(look[1]) for look in looks))
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)  # noqa: B023
        for ms in sorted(t for t in handle.timers if t < watermark):
            handle.timers.remove(ms)
            passed += gate.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda: ms))  # noqa: B023
        watermark = max(watermark, newest - late)
    return [(row.path, row.at, row.tie) for row in passed], handle


def plain(looks, seconds):
    last, out = {}, []
    for path, at, tie, _ in sorted(looks, key=lambda look: (look[1], look[2] or 0)):
        if path not in last or at - last[path] >= seconds * SECOND:
            last[path] = at
            out.append((path, at, tie))
    return out


def _looks(seed, count, paths):
    rng = random.Random(seed)
    return [(rng.choice(paths), rng.randrange(20_000) * SECOND // 3, k, rng.choice("xy")) for k in range(count)]


@pytest.mark.parametrize("paths", [["busy"], [None, "", "a", "b"], [f"p{k}" for k in range(300)]])
def test_looks_of_one_batch_share_calls_of_the_store(paths):
    looks = _looks(1, 6000, paths)
    end = ("end", 10**6 * SECOND, -1, "z")
    found, handle = run(T._Cooldown(300), [looks[:2500], looks[2500:4000], [*looks[4000:], end]], late=7000 * 1000)
    key = lambda f: (f[1], f[2])
    assert sorted((f for f in found if f[0] != "end"), key=key) == plain(looks, 300)
    assert handle.calls < 6000


def test_a_busy_path_is_cut_into_spans(monkeypatch):
    monkeypatch.setattr(T, "LOOKS_PER_SPAN", 8)
    looks = _looks(2, 900, ["busy"])
    gate, handle = T._Cooldown(60), Handle()
    gate.init(handle)
    rows = [SimpleNamespace(path=p, at=at, tie=tie, sha256=sha) for p, at, tie, sha in looks]
    list(gate.handleInputRows((0,), iter(rows), None))
    assert max(len(T.json.loads(value[0])) for value in handle.held["waiting"].values() if value[0]) <= 8
    steps = [[look for look in looks if look[2] % 3 == k] for k in range(3)] + [[("end", 10**6 * SECOND, -1, "z")]]
    found, handle = run(T._Cooldown(60), steps, late=7000 * 1000)
    assert [f for f in found if f[0] != "end"] == plain(looks, 60)


def test_states_of_paths_end():
    looks = [(f"p{k % 50}", k * 10 * SECOND, k, "x") for k in range(500)]
    batches = [looks[k : k + 100] for k in range(0, 500, 100)] + [[("end", 10**6 * SECOND, -1, "z")]]
    found, handle = run(T._Cooldown(30), [*batches, [("end", 2 * 10**6 * SECOND, -2, "z")]], late=0)
    assert len([f for f in found if f[0] != "end"]) == 500
    assert {path for _, path in handle.held["last"]} <= {"end"}
    near = [("a", 0, 0, "x"), ("a", 100 * SECOND, 1, "x"), ("a", 201 * SECOND, 2, "x"), ("a", 250 * SECOND, 3, "x")]
    for batches in ([near], [[look] for look in near], [near[:2], near[2:]]):
        found, _ = run(T._Stable(100), [*batches, [("end", 10**6 * SECOND, -1, "z")]], late=0)
        assert [f[2] for f in found] == [1, 3]  # at 201 the state of 100 was over


@pytest.mark.parametrize("room", [1024, 20])
def test_states_of_many_paths_share_calls_of_the_store(monkeypatch, room):
    monkeypatch.setattr(T, "STATES_PER_GROUP", room)
    looks = _looks(3, 4000, [None, "", *(f"p{k}" for k in range(400))])
    steps = [[look for look in looks if look[2] % 4 == k] for k in range(4)] + [[("end", 10**6 * SECOND, -1, "z")]]
    for gate in (T._Cooldown(300), T._Stable(None), T._Stable(500)):
        found, handle = run(gate, steps, late=7000 * 1000)
        whole, _ = run(gate, [looks, steps[-1]], late=7000 * 1000)
        assert found == whole and len(found) > 100
        if isinstance(gate, T._Cooldown):
            assert sorted((f for f in found if f[0] != "end"), key=lambda f: f[1:]) == plain(looks, 300)
        assert room == 20 or handle.calls < 200
        assert len(handle.held["last"]) == sum(value[1] for value in handle.held["few"].values())
        assert sum(len(T.json.loads(value[0])) for value in handle.held["few"].values()) <= room


def test_every_time_has_its_place(spark):
    """Event times stay in order and within what a frame holds, and are those of the gate's spans."""
    days = [-719_162, -200_000, -25_568, -25_567, -25_566, -1, 0, 19_723, 47_481, 47_482, 47_483, 90_000, 2_932_896]
    times = sorted(day * 86_400 * SECOND + more for day in days for more in (0, 1, 999, 1000, 77_777))
    moved = spark.createDataFrame([(at,) for at in times], "at long").select("at", T.F.unix_micros(T._moved(T.F.col("at"))).alias("moved")).collect()
    assert [-(-row.moved // 1000) for row in moved] == [T._Stable(None)._at(row.at) for row in moved]
    found = [row.moved for row in sorted(moved, key=lambda row: row.at)]
    assert found == sorted(found) and found[0] > 0 and found[-1] < 2**63 // 1000


def _events(spark, folder):
    """Looks of many times and some far off, missing ones and such of one time."""
    rows = [(k, k % 7, 1_700_000_000 + k * 3571 % 2_600_000, "abc"[k % 3]) for k in range(900)]
    rows += [(1000, 3, None, "z"), (1001, 3, 1_700_000_000, "a"), (1002, 3, 1_700_000_000, "a"), (2**60 + 1, 3, 1_700_000_000, "a"), (1003, 2, 1_700_000_500, None), (1004, 2, 1_700_000_500, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, second long, event_type string").selectExpr(
        "event_id", "user_id", "timestamp_seconds(second) AS ts", "event_type", "1.0D AS value", "'{}' AS props"
    ).write.parquet(f"{folder}/events.parquet")


def test_parts_of_several_files_are_one_batch_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "LOOKS_PER_FILE", 50)
    _events(spark, tmp_path)
    looks, home = E._observed(spark, str(tmp_path), day=True)
    files = spark.read.parquet(f"{home}/looks").inputFiles()
    assert len(files) == 4 * 5 + 1
    sizes = []
    looks.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).trigger(availableNow=True).start().awaitTermination(300)
    assert len(sizes) == 5 and sizes[-1] == 1 and sum(sizes) == 907
    for stream, batch in (("stream_stable", "file_stable"), ("stream_cooldown", "event_cooldown")):
        found, expected = (E.queries()[name](spark, str(tmp_path)).collect() for name in (stream, batch))
        assert sorted(map(repr, found)) == sorted(map(repr, expected)) and found


def test_gate_of_a_stream_with_far_times_and_large_ties(spark, tmp_path):
    days = [-719_162, -719_161, -40_000, -39_999, -3, 0, 1, 40_000, 60_000, 60_001, 2_900_000]
    looks = [(path, day, 2**62 + day if day % 2 else None, sha) for day in days for path, sha in (("a", "x"), ('q"]\\\n\u00e9', None), (None, "y"))]
    frame = spark.createDataFrame(looks, "path string, day long, number long, sha256 string").selectExpr(
        "path", "timestamp_seconds(day * 86400) AS ts", "sha256", "number"
    )
    frame.coalesce(1).write.parquet(str(tmp_path / "log"))
    frame.limit(1).selectExpr("'end' AS path", "timestamp_seconds(2932800L * 86400) AS ts", "'z' AS sha256", "1L AS number").write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("path string, ts timestamp, sha256 string, number long").parquet(str(tmp_path / "log"))
    query = T.stream_stable(stream, late="1 day", tie="number").writeStream.format("memory").queryName("far_looks").trigger(availableNow=True).start()
    query.awaitTermination(300)
    found = spark.table("far_looks").selectExpr("path", "unix_seconds(ts) div 86400 AS day", "number", "sha256").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(look) for look in looks if look[1] > days[0])
