"""Replay of blocks, accounts of what streams read, confirmation within a stream, idle streams, and sinks that fail."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chirplake.operators.confirm import Variants, with_evidence
from chirplake.operators.detector import END, Rules, detect
from chirplake.sources.replay import BlockReplay, block_time, write_recordings
from chirplake.streaming.detection import counts_of, detect_stream, events_of, late_of, outcome_stream, with_ends
from chirplake.streaming.fanout import FanOut, csv_sink, json_lines, json_sink, summary_lines, tap

SCORES = "stream long, ts timestamp, level double, rk int, item string, score double"


def windows(streams=3, n=120, seed=4):
    random = np.random.default_rng(seed)
    out = []
    for stream in range(streams):
        t = 0
        for _ in range(n):
            t += int(random.integers(5, 60))
            out.append((stream, pd.Timestamp(t, unit="ms"), float(random.choice([-70.0, -20.0])), 1, str(random.choice(list("ABC"))), float(random.uniform(0.6, 1))))
    return pd.DataFrame(out, columns=["stream", "ts", "level", "rk", "item", "score"])


def as_batch(df):
    return df.selectExpr("stream", "double(unix_millis(ts)) as t", *[c for c in df.columns if c not in ("stream", "ts")])


def run(spark, stream, path, name):
    query = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-check").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


def rows(df):
    return sorted(map(repr, df.select("stream", "item", "score", "at").collect()))


def test_all_that_is_read_is_stepped_through_or_late(spark, tmp_path):
    """Files in a shuffled order of time: what comes too late is counted and kept apart, and each batch's outcomes are told."""
    table, path = windows(), str(tmp_path / "in")
    order = np.random.default_rng(1).permutation(12)
    cuts = np.array_split(table.sort_values("ts", kind="stable"), 12)
    for k in order:
        spark.createDataFrame(cuts[k], SCORES).coalesce(1).write.mode("append").parquet(path)
    ends = pd.DataFrame([(s, pd.Timestamp(10**7, unit="ms"), None, END, None, None) for s in range(3)], columns=table.columns)
    spark.createDataFrame(ends, SCORES).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(path)
    out = run(spark, outcome_stream(source, Rules(), late_ms=300), tmp_path, "out").persist()
    told = {r.stream: r for r in counts_of(out).collect()}
    late = {(r.stream, round(r["at"])) for r in late_of(out).collect()}
    assert late and all(told[s].stepped - 1 + told[s].late == 120 for s in range(3))
    assert all(told[s].ticks == told[s].stepped - 1 and told[s].late == sum(x[0] == s for x in late) for s in range(3))
    kept = table[[(r.stream, round(r.ts.timestamp() * 1000)) not in late for r in table.itertuples()]]
    batch = detect(as_batch(spark.createDataFrame(kept, SCORES)), Rules())
    assert rows(events_of(out)) == rows(batch)
    assert all(told[s].fired == sum(json.loads(x)["stream"] == s for x in [r.value for r in json_lines(events_of(out)).collect()]) for s in range(3))


def test_a_stream_is_confirmed_as_the_batch_is(spark, tmp_path):
    random, table = np.random.default_rng(6), windows(n=200)
    u = {i: random.standard_normal(6) for i in "ABC"}
    variants = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in u.items()], "item string, u array<double>")
    v = [(u[i] + random.standard_normal(6) * 0.9) for i in table["item"]]
    table["v"] = [(x / np.linalg.norm(x)).tolist() for x in v]
    table["energies"] = [(10 ** random.uniform(-9, -3, 12)).tolist() for _ in v]
    schema, rules = SCORES + ", v array<double>, energies array<double>", Rules(hold_ms=40, cooldown_ms=100, margin=0)
    for part in (table.iloc[1::2], table.iloc[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ends = spark.createDataFrame([(s, datetime.datetime(1970, 1, 2)) for s in range(3)], "stream long, ts timestamp")
    held = Variants(variants)
    evidence = lambda df: with_evidence(df, held, rise_db=12.0, least_score=0.75)
    table_df = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    told, plain = detect(as_batch(evidence(table_df)), rules), detect(as_batch(table_df), rules)
    spark.read.schema(schema).parquet(str(tmp_path / "in")).write.parquet(str(tmp_path / "all"))
    with_ends(table_df, ends).where(F.col("rk") == END).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    streamed = run(spark, detect_stream(evidence(source), rules, late_ms=10**7), tmp_path, "out")
    assert rows(streamed) == rows(told)
    assert 0 < told.count() < plain.count()


def test_an_idle_stream_is_ended_and_forgotten(spark, tmp_path):
    row = lambda stream, t: (stream, datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=t), -20.0, 1, "A", 0.9)
    for part in ([row(1, 0), row(1, 1000)], [row(2, 5)], [row(1, 500)]):
        spark.createDataFrame(part, SCORES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(spark, outcome_stream(source, Rules(hold_ms=-1), late_ms=10**6, idle_ms=1), tmp_path, "out").collect()
    # Stream 1 waits in the first batch, is stepped through when the second finds it idle, and begins anew in the third, as 2 is ended.
    assert [(r.stream, r["at"]) for r in out if r.kind == "event"] == [(1, 0.0), (1, 1000.0), (2, 5.0)]
    assert [r.n for r in out if r.kind == "stepped" and r.stream == 1] == [2] and not [r for r in out if r.kind == "late"]


def recordings(spark, path):
    table = [("a", [float(k) for k in range(25)]), ("b", [0.5] * 8), ("c", []), (None, [1.0, 2.0, 3.0]), ("d", None)]
    df = spark.createDataFrame(table, "stream string, pcm array<double>")
    for k in range(2):
        write_recordings(df.where("stream <=> 'a'") if k else df.where("not stream <=> 'a'"), f"{path}/{k}")
    return {(s, k): x[4 * k : 4 * k + 4] for s, x in table if x for k in range(-(-len(x) // 4))}


@pytest.mark.parametrize("pace", [0, 3])
def test_replayed_blocks_are_the_recordings(spark, tmp_path, pace):
    expected = recordings(spark, str(tmp_path / "in"))
    spark.dataSource.register(BlockReplay)
    stream = spark.readStream.format("recording_blocks").options(path=str(tmp_path / "in"), block=4, rate=1000, pace=pace).load()
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    if pace:
        query = writer.trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        assert query.lastProgress.batchId >= 1
        query.stop()
        query = writer.trigger(processingTime="0 seconds").start()  # a restart goes on from the offset
        query.processAllAvailable()
        query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) == len(expected) and {(r.stream, r.seq): list(r.pcm) for r in found} == expected
    assert all(r.last == ((r.stream, r.seq + 1) not in expected) for r in found)
    assert all(r.ts == datetime.datetime(1970, 1, 1) + block_time(r.seq, 4, 1000) for r in found)


def test_replay_refuses_bad_options(spark, tmp_path):
    spark.dataSource.register(BlockReplay)
    with pytest.raises(Exception, match="block and rate"):
        query = spark.readStream.format("recording_blocks").options(path=str(tmp_path), block=0).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()


def outcomes(spark, n):
    kinds = "stream long, kind string, n long, ticks long, silent long, rejected long, fired long, item string, score double, margin double, level double, at double"
    return spark.createDataFrame([(1, "event", None, None, None, None, None, f"item {n}", 0.9, None, float("-inf"), float(n)), (1, "stepped", 5, 4, 1, 2, 1, None, None, None, None, None)], kinds)


def test_each_sink_gets_each_batch_once(spark, tmp_path):
    """One sink fails three times, after writing in part: its batches are kept and given in order; a batch that Spark repeats is given to nobody again."""
    given, fails = {"good": [], "bad": []}, [1, 1, 1]
    write = json_sink(str(tmp_path / "json"))

    def bad(rows, n):
        write(rows, n)
        if fails and n >= 1:
            fails.pop()
            raise OSError("disk full")
        given["bad"].append(n)

    sinks = {"bad": bad, "good": lambda rows, n: given["good"].append(n), "csv": csv_sink(str(tmp_path / "csv"))}
    fan = FanOut(spark, sinks, f"file://{tmp_path}/fan")
    for n in (0, 1, 1, 2):
        fan.batch(outcomes(spark, n), n)
    assert given["good"] == [0, 1, 2] and given["bad"] == [0] and "disk full" in fan.errors["bad"]
    FanOut(spark, sinks, f"file://{tmp_path}/fan").batch(outcomes(spark, 3), 3)  # after a restart
    assert given == {"good": [0, 1, 2, 3], "bad": [0, 1, 2, 3]} and fan.drain()
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(x["at"] for x in lines if x["type"] == "event") == [0, 1, 2, 3] and all(x["level"] is None for x in lines if x["type"] == "event")
    assert [x for x in lines if x["type"] == "tick"] == [{"type": "tick", "stream": 1, "rows": 5, "ticks": 4, "silent": 1, "rejected": 2, "fired": 1}] * 4
    assert sorted(r.item for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [f"item {n}" for n in range(4)]
    summary = json.loads(summary_lines(counts_of(outcomes(spark, 0)), "end").first().value)
    assert summary == {"type": "summary", "stream": 1, "stepped": 5, "late": 0, "ticks": 4, "silent": 1, "rejected": 2, "fired": 1, "reason": "end"}


def test_fan_out_of_a_stream_and_a_tap_that_fails(spark, tmp_path):
    spark.createDataFrame(windows(n=40), SCORES).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCORES).parquet(str(tmp_path / "in"))
    told = []

    def broken(rows, n):
        raise ValueError("tap")

    fan = FanOut(spark, {"json": json_sink(str(tmp_path / "json")), "tap": tap(broken, told.append)}, f"file://{tmp_path}/fan")
    fan.start(outcome_stream(source, Rules(hold_ms=-1), late_ms=0)).trigger(availableNow=True).start().awaitTermination(120)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert told == ["tap"] and not fan.errors and sum(x["rows"] for x in lines if x["type"] == "tick") == 120


class Calls:
    """State that counts what it is asked, as each call of a stream's goes to Spark's process and back."""

    def __init__(self):
        self.n, self.value, self.rows = 0, None, []

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return Waiting(self)

    def getMapState(self, name, *schemas):
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n += 1
        self.value = value

    def registerTimer(self, at):
        self.n += 1

    deleteTimer = registerTimer

    def getCurrentProcessingTimeInMs(self):
        return 1000


class Waiting:
    def __init__(self, calls):
        self.calls = calls

    def get(self):
        self.calls.n += 1
        return iter(self.calls.rows)

    def put(self, rows):
        self.calls.n += 1
        self.calls.rows = list(rows)

    def appendList(self, rows):
        self.put(self.calls.rows + list(rows))

    def clear(self):
        self.put([])


def test_calls_to_the_state_are_few(spark):
    """Three for a stream that comes and ends in a batch, six for one whose rows wait and are stepped through in the next; the outcomes are those of one batch."""
    from pyspark.sql import Row

    from chirplake.streaming.detection import Stepper

    table = [(7, float(40 * k), -20.0, 1, "AB"[k // 6 % 2], 0.8 + k % 5 / 50, None, None) for k in range(40)]
    table.append((7, 9999.0, None, END, None, None, None, None))
    names = Row("stream", "t", "level", "rk", "item", "score", "accept", "onset")

    def stepped(parts):
        state, made, told = Calls(), [], []
        stepper = Stepper(Rules(), 10**7, 10**6)
        stepper.init(state)
        for part in parts:
            before = state.n
            made += stepper.handleInputRows((7,), iter([names(*r) for r in part]), state)
            told.append(state.n - before)
        return made, told

    whole, once = stepped([table])
    parts, twice = stepped([table[::2][:-1], table[1::2] + table[-1:]])
    assert once == [3] and twice == [4, 6]
    assert whole == parts and sum(r.kind == "event" for r in whole) > 1 and whole[-1].n == 41
