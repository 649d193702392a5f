"""Stateful streams against batches, with late rows and a restart; autosaves that count a repeated batch once."""

from pyspark.sql import functions as F

from lectern.streaming import incremental, state

SCHEMA = "key string, ts timestamp, event_id long"


def events(spark, n=240):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600 + F.pmod(F.xxhash64("id"), F.lit(5000)))
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id") % 4).alias("key"), t.alias("ts"), F.col("id").alias("event_id"))


def test_cache_stream(spark):
    df = events(spark)
    got = state.replay(df, lambda s: state.cache_stream(s, 6 * 3600, "1 day"))
    want = sorted((r.event_id, r.hit) for r in incremental.cache_outcomes(df, 6 * 3600).collect())
    assert sorted((r.event_id, r.hit) for r in got.collect()) == want and {h for _, h in want} == {True, False}


def test_threshold_stream(spark):
    df = events(spark)
    got = sorted((r.key, r.firing, r.event_id, len(r.members)) for r in state.replay(df, lambda s: state.threshold_stream(s, 7, "1 day")).collect())
    want = sorted((r.key, r.firing, r.event_id, 7) for r in incremental.trigger_points(df, 7, "key").collect())
    assert got == want


def test_replay_of_nothing(spark):
    assert state.replay(spark.createDataFrame([], SCHEMA), lambda s: state.cache_stream(s) if s.isStreaming else s.selectExpr("key", "event_id", "true as hit")).collect() == []


def test_autosaver_counts_a_batch_once(spark, tmp_path):
    saved = []
    batch = state.autosaver(str(tmp_path / "counts"), lambda df, total: saved.append(total), 100)
    for number, n in ((0, 60), (1, 30), (1, 30), (2, 15), (2, 15), (3, 20)):
        batch(spark.range(n), number)
    assert saved == [105, 105]  # batch 2, and again when it was repeated
    again = state.autosaver(str(tmp_path / "counts"), lambda df, total: saved.append(total), 100)
    again(spark.range(80), 4)
    assert saved[2:] == [205]


def test_autosaved(spark):
    out = state.autosaved(spark.range(1000).select(F.col("id").alias("event_id")), "event_id % 4", 4, 400)
    assert sorted((r.total, r.rows) for r in out.collect()) == [(500, 250), (1000, 250)]


class States:
    """A handle whose list and value states are counted lists."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, schema):
        return State(self)

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    def __init__(self, owner):
        self.owner, self.rows = owner, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.owner.calls += 1
        return self.rows

    def put(self, rows):
        self.owner.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        self.owner.calls += 1
        self.rows = [*self.rows, *rows]

    def update(self, row):
        self.rows = row

    def clear(self):
        self.rows = []


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def rows_of(n, late=0):
    import pandas as pd

    return pd.DataFrame({"bucket": 0, "key": [None if i % 7 == 0 else f"k{i % 5000}" for i in range(n)], "ts": pd.to_datetime([1_000_000 * (i % 3 + 1 + late) for i in range(n)], unit="us"), "event_id": range(n)})


def test_cache_takes_few_calls_for_many_keys():
    """A stream of many keys called the state store several times for each."""
    handle, cache = States(), state.ResponseCache(3600)
    cache.init(handle)
    list(cache.handleInputRows((0,), iter([rows_of(10_000)]), None))
    out = list(cache.handleExpiredTimer((0,), Clock(10_000), None))
    assert len(out) == 1 and len(out[0]) == 10_000 and handle.calls < 10
    assert (~out[0]["hit"]).sum() == out[0]["key"].nunique(dropna=False)  # one miss a key
    assert len(cache.state.rows) == out[0]["key"].nunique(dropna=False) and handle.timers == {1_001, 3_601_001}  # the first has fired
    list(cache.handleExpiredTimer((0,), Clock(10_000_000), None))
    assert cache.state.rows == [] and cache.waiting.rows == []


def test_counter_takes_few_calls_for_many_keys():
    handle, counter = States(), state.ThresholdCounter(2)
    counter.init(handle)
    for late in (0, 10):
        list(counter.handleInputRows((0,), iter([rows_of(10_000, late)]), None))
    first, second = (list(counter.handleExpiredTimer((0,), Clock(now), None))[0] for now in (5_000, 20_000))
    assert handle.calls < 12 and {len(m) for m in [*first["members"], *second["members"]]} == {2}
    assert counter.waiting.rows == [] and sum(len(r[2]) for r in counter.state.rows) + 2 * (len(first) + len(second)) == 20_000


def test_partitions_of_state():
    """Small streams don't pay for as many state stores as a session has shuffle partitions; large ones have more."""
    assert [state.partitions_for(n, 12, 100) for n in (0, 100_000, 1_200_000, 6_000_000, 10**9)] == [12, 12, 12, 60, 100]
    assert state.partitions_for(10, 12, 8) == 8
