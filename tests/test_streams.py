"""Streams over several micro-batches against batch: timers, late rows, forgotten state."""

import time
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenlake.plans import catalog
from screenlake.streaming import timed

ROWS = "video long, t long, seq long, call string, level double, frac double"


@pytest.fixture
def two_partitions(spark):
    """Few state stores, so that many micro-batches take seconds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def stream_of(spark, parts, schema, path):
    """A file stream that takes one part at a time."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def at(df):
    return df.withColumn("at", F.timestamp_seconds("t"))


def test_stretches_out_of_order_and_late(spark, tmp_path, two_partitions):
    r = random.Random(4)
    rows = [(v, 1000 + 10 * k, k, r.choice(["screen"] * 4 + ["camera"]), float(r.randint(0, 9)), r.random()) for v in (1, 2, 3) for k in range(40)] + [(None, 1500, 1, "screen", 1.0, 1.0), (4, 1100, 0, "screen", None, None)]
    due = sorted(rows, key=lambda x: x[1] + r.randint(0, 60))  # up to a minute out of order
    late = [(1, 1001, 99, "camera", 0.0, 0.5)]
    parts = [due[:50], due[50:100], due[100:], late]
    carrier = timed.Stretches(4.0, 500)
    run = timed.closed(at(stream_of(spark, parts, ROWS, tmp_path)), "video", carrier, "70 seconds", "t")
    want = timed.fold_in_order(spark.createDataFrame(rows, ROWS), "video", carrier).collect()
    assert {tuple(x) for x in run.table().collect()} == {tuple(x) for x in want} and len(want) > 20
    assert run.late == 1
    from screenlake.operators import states

    known = spark.createDataFrame([x for x in rows if x[0] in (1, 2, 3)], ROWS)
    assert {tuple(x) for x in states.stretches(known, 4.0).collect()} == {tuple(x) for x in want if x[0] != 4}


def test_a_pause_closes_a_stretch(spark):
    rows = [(1, t, t, "screen", 1.0, 0.5) for t in (10, 20, 500, 510)]
    got = timed.fold_in_order(spark.createDataFrame(rows, ROWS), "video", timed.Stretches(4.0, 100)).collect()
    assert sorted((x.start, x.end, x.n) for x in got) == [(10, 20, 2), (500, 510, 2)]


def test_window_states_stitch_and_close(spark, tmp_path, two_partitions):
    a, b, c = "one\ntwo\nthree\nfour", "two\nthree\nfour\nfive", "other\nlines"
    rows = [(1, 10, 0, a), (1, 20, 0, a), (1, 30, 0, b), (1, 40, 0, c), (2, 10, 0, c)]
    schema = "video long, t long, seq long, said string"
    run = timed.closed(at(stream_of(spark, [rows[:2], rows[2:]], schema, tmp_path)), "video", timed.WindowStates(1000), "1 second", "t")
    want = [(1, 10, 30, 5), (1, 40, 40, 2), (2, 10, 10, 2)]
    assert sorted(tuple(x) for x in run.table().collect()) == want
    assert sorted(tuple(x) for x in timed.fold_in_order(spark.createDataFrame(rows, schema), "video", timed.WindowStates(1000)).collect()) == want


def test_screens_take_the_running_cue(spark, tmp_path, two_partitions):
    cue, screen = (lambda v, t, s: (v, t, t, 0, t, s)), (lambda v, t: (v, t, t + 10_000, 1, t, None))
    rows = [cue(1, 5, "a"), screen(1, 10), cue(1, 12, "b"), cue(1, 19, "c"), screen(1, 20), screen(1, 60), cue(1, 60, "d"), cue(1, 95, "e"), screen(2, 7)]
    schema = "video long, t long, rank long, side int, seq long, text string"
    run = timed.closed(at(stream_of(spark, [rows[:3], rows[3:6], rows[6:]], schema, tmp_path)), "video", timed.CuesOnScreens(30, 1000), "100 seconds", "t")
    want = {(1, 10, 10, 20, "b c"), (1, 20, 20, 60, "c"), (1, 60, 60, 90, "d"), (2, 7, 7, 37, None)}
    assert {tuple(x) for x in run.table().collect()} == want
    assert {tuple(x) for x in timed.fold_in_order(spark.createDataFrame(rows, schema), "video", timed.CuesOnScreens(30, 1000)).collect()} == want


def test_remembered_state_stays_flat(spark, tmp_path, two_partitions):
    """Twelve micro-batches of ever new rectangles: entries older than 100 seconds are swept out."""
    schema = "video long, ts long, seq long, rect long, said string"
    parts = [[(1, 1000 + 100 * k + j, j, 10 * k + j, f"w{k} x") for j in range(10)] for k in range(12)]
    s = stream_of(spark, parts, schema, tmp_path).withColumn("at", F.timestamp_seconds("ts"))
    told = timed.remembered(s, "video", ["ts", "seq"], ("rect long", "words array<string>"), "video long, ts long, rect long, newly string", timed.newly, 100, "1 second")
    run = timed.Run(told, "flat").go()
    assert run.table().count() == 120
    assert max(run.sizes) < 70  # entries and timers of a few batches, of 120 that came


def test_newly_and_carried_words():
    held = {}
    say = lambda x: timed.newly(held.get, held.__setitem__, {"video": 1, "ts": 0, "rect": 0, "said": x})[0][3]
    assert say("a b b") == "a b" and say("B c") == "c" and say("b") == "" and say("a") == "a"
    held, step = {}, timed.carried_words(4)
    row = lambda t, x, words: {"video": 1, "t": t, "id": t, "x0": x, "y0": 10, "x1": x + 20, "y1": 30, "words": words}
    assert step(held.get, held.__setitem__, row(1, 10, "file edit")) == [] and step(held.get, held.__setitem__, row(2, 13, "view")) == []
    assert step(held.get, held.__setitem__, row(3, 12, None)) == [(1, 3, 3, "view", 2)]
    assert step(held.get, held.__setitem__, row(4, 9, None)) == [(1, 4, 4, "view", 2)] and step(held.get, held.__setitem__, row(5, 40, None)) == []


@pytest.mark.parametrize("name", ["ST02_newly_readable", "ST04_unchanged", "ST06_standing_text"])
def test_tables_that_are_folders_of_files(name, spark, sf, tmp_path, two_partitions):
    for t in ("conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(300).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(catalog.ORACLE[name])
    want = cur.fetchall()
    assert want and sorted(map(tuple, got.select(*(d[0] for d in cur.description)).collect())) == sorted(want)


def test_carried_words_look_at_the_newest_readings_only():
    held, step = {}, timed.carried_words(60)
    row = lambda t, x, words: {"video": 1, "t": t, "id": t, "x0": x, "y0": 10, "x1": x + 20, "y1": 30, "words": words}
    begun = time.perf_counter()
    for t in range(6_000):
        step(held.get, held.__setitem__, {**row(t, t % 61, "w"), "y0": t // 61 % 61, "y1": t // 61 % 61 + 20})
    assert step(held.get, held.__setitem__, row(6_000, 10, None))[0][4] == 5_999
    assert time.perf_counter() - begun < 2  # a copy of the cell at each reading took longer


def test_carried_words_of_one_second(spark):
    held, step = {}, timed.carried_words(60)
    row = lambda t, words: {"video": 1, "t": t, "id": 0, "x0": 5, "y0": 10, "x1": 20, "y1": 30, "words": words}
    for t in [*range(40), 40]:
        step(held.get, held.__setitem__, row(t, f"w{t}"))
    assert step(held.get, held.__setitem__, row(40, None)) == [(1, 40, 0, "w39", 39)]


def test_columns_of_a_batch_are_packed():
    parts = [pd.DataFrame({"t": [3, 1], "w": ["a" * 2, None], "at": [0, 0]}), pd.DataFrame({"t": [2], "w": ["".join(["a", "a"])], "at": [0]})]
    cols, order = timed._columns(iter(parts), ["t"])
    assert list(cols) == ["t", "w"] and order.tolist() == [1, 2, 0] and cols["t"].dtype == "int64" and cols["w"][0] is cols["w"][2]
