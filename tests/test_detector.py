"""The detector's rules at their edges, batch against stream, and brute force over random windows."""

import numpy as np
import pandas as pd

from chirplake.operators.detector import Detector, Rules, detect, outcomes, with_changes
from chirplake.operators.series import cooldown
from chirplake.streaming.detection import detect_stream
from chirplake.streaming.fanout import csv_lines, json_lines

NO_HOLD = Rules(hold_ms=-1)


def times(rules, steps):
    d = Detector(rules)
    return [t for t, level, ranking in steps if d.step(t, level, ranking)]


A, B = [("A", 0.9)], [("B", 0.9)]


def test_cooldown_is_per_item_and_from_the_last_event():
    assert times(NO_HOLD, [(t, -20, A) for t in (0, 10, 100, 401)]) == [0, 401]


def test_refractory_is_for_all_items():
    assert times(NO_HOLD, [(0, -20, A), (20, -20, B), (60, -20, B)]) == [0, 60]


def test_the_gate_is_passed_by_an_equal_level():
    assert times(NO_HOLD, [(0, -60, A)]) == [0]
    assert times(NO_HOLD, [(0, -60.001, A), (1, None, A)]) == []


def test_margin_counts_another_item_only():
    assert times(NO_HOLD, [(0, -20, [("A", 0.9), ("B", 0.87)])]) == []
    assert times(NO_HOLD, [(0, -20, [("A", 0.9), ("A", 0.89), ("B", 0.8)])]) == [0]


def test_hold_is_fired_by_silence_and_by_time():
    rules = Rules(hold_ms=40)
    assert times(rules, [(0, -20, A), (10, None, A)]) == [10]
    assert times(rules, [(0, -20, A), (20, -20, A), (45, -20, A)]) == [45]


def test_hold_reports_the_best_score_and_another_item_is_not_armed_at_once():
    d = Detector(Rules(hold_ms=100, refractory_ms=0))
    assert d.step(0, -20, [("A", 0.8)]) is None
    assert d.step(10, -20, [("A", 0.95)]) is None
    assert d.step(20, -20, B)["score"] == 0.95
    assert d.held is None


def test_a_refused_confirmation_leaves_the_timers():
    d = Detector(NO_HOLD, confirm=lambda held: False)
    assert d.step(0, -20, A) is None and d.last_any is None and d.counts["rejected"] == 1


def scores():
    rng = np.random.default_rng(4)
    out = []
    for stream in range(3):
        t = 0
        for _ in range(120):
            t += int(rng.integers(5, 60))
            out.append((stream, pd.Timestamp(t, unit="ms"), float(rng.choice([-70.0, -20.0])), 1, str(rng.choice(list("ABC"))), float(rng.uniform(0.6, 1))))
    return pd.DataFrame(out, columns=["stream", "ts", "level", "rk", "item", "score"])


SCHEMA = "stream long, ts timestamp, level double, rk int, item string, score double"


def test_stream_equals_batch_whatever_the_order_of_files(spark, tmp_path):
    rules, table = Rules(hold_ms=40, cooldown_ms=150), scores()
    batch = spark.createDataFrame(table, SCHEMA).selectExpr("stream", "double(unix_millis(ts)) as t", "level", "rk", "item", "score")
    wanted = sorted(map(tuple, detect(batch, rules).toPandas()[["stream", "item", "at"]].to_numpy().tolist()))
    end = pd.DataFrame([(s, pd.Timestamp(10**7, unit="ms"), None, 1, None, None) for s in range(3)], columns=table.columns)
    for k, part in enumerate([table.iloc[1::2], table.iloc[::2], end, end]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = detect_stream(source, rules, late_ms=60_000)
    query = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("found").toPandas()[["stream", "item", "at"]].to_numpy().tolist()))
    assert wanted and got == wanted


def test_changes_hold_from_their_time_on(spark):
    table = [(1, float(t), -20.0, 1, "A", 0.8) for t in (0, 1000, 2000, 3000)]
    scores = spark.createDataFrame(table, "stream long, t double, level double, rk int, item string, score double")
    changes = spark.createDataFrame([(1, 1000.0, "A", 0.9), (1, 2001.0, "A", None), (2, 5.0, "A", 0.1)], "stream long, t double, item string, threshold double")
    assert sorted(r["at"] for r in detect(with_changes(scores, changes), NO_HOLD).collect()) == [0, 3000]


def test_groups_go_over_the_ends_of_batches(spark):
    table = scores().assign(t=lambda d: d["ts"].astype("int64") // 10 ** (6 if d["ts"].dtype.str.endswith("[ns]") else 3)).drop(columns="ts").astype(object)
    table.loc[table["stream"] == 1, "stream"] = None
    rows = [tuple(None if pd.isna(v) else float(v) if n in ("t", "level", "score") else v for n, v in r.items()) for r in table.to_dict("records")]
    df = spark.createDataFrame([tuple(r) for r in rows], "stream long, level double, rk int, item string, score double, t double")
    steps = df.selectExpr("stream", "timestamp_millis(cast(t as long)) as t", "cast(t as long) as id", "item", "score as value")
    wait = pd.Timedelta(milliseconds=90)
    whole = [sorted(map(repr, d.collect())) for d in (detect(df, Rules()), outcomes(df, Rules()), cooldown(steps, ["stream", "item"], wait))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        small = [sorted(map(repr, d.collect())) for d in (detect(df, Rules()), outcomes(df, Rules()), cooldown(steps, ["stream", "item"], wait))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == whole and len(whole[1]) == 3 and all(whole)


def test_a_reset_forgets_timers_and_counts_and_keeps_thresholds(spark):
    table = [(1, float(t), -20.0, 1, i, 0.8) for t, i in ((0, "A"), (100, "A"), (101, "B"))]
    scores = spark.createDataFrame(table, "stream long, t double, level double, rk int, item string, score double")
    changes = spark.createDataFrame([(1, 0.0, "B", 0.9), (1, 100.0, None, None)], "stream long, t double, item string, threshold double")
    both = with_changes(scores, changes)
    assert sorted(r["at"] for r in detect(both, NO_HOLD).collect()) == [0, 100]
    assert outcomes(both, NO_HOLD).first().asDict() == {"stream": 1, "ticks": 2, "silent": 0, "rejected": 1, "fired": 1}


def test_sinks(spark):
    events = spark.createDataFrame([(1, "A", 0.91234, None, float("-inf"), 10.0)], "stream long, item string, score double, margin double, level double, at double")
    assert csv_lines(events).first().margin == "+inf"
    assert json_lines(events).first().value == '{"stream":1,"item":"A","score":0.91234,"margin":null,"level":null,"at":10.0}'
