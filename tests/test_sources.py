"""Bars, catalogues, logs and streams."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from tests.test_windows import bars, walk
from tickloom.functions.series import Series
from tickloom.operators.indicators import indicators
from tickloom.sources import bars as B
from tickloom.sources import catalogue, training_log
from tickloom.streaming.bars import _decayed, streaming_bars, streaming_ewm, streaming_sessions


def test_catalogues(spark, tmp_path):
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute('CREATE TABLE "odd name" (Symbol TEXT, Name TEXT, more INT)')
        db.executemany('INSERT INTO "odd name" VALUES (?, ?, 1)', [("A", "Alpha"), ("B", ""), (None, "None"), ("C", "x - y")])
    df = catalogue.read_catalogue(spark, str(tmp_path / "c.db"), "sqlite")
    assert df.count() == 4
    named = catalogue.labels(df).select("label", catalogue.symbol_of("label").alias("s")).collect()
    assert {(r.label, r.s) for r in named} == {("A - Alpha", "A"), ("C - x - y", "C")}
    sqlite3.connect(tmp_path / "empty.db").close()
    assert catalogue.read_catalogue(spark, str(tmp_path / "empty.db"), "sqlite").count() == 0
    assert catalogue.read_catalogue(spark).count() == 10 and catalogue.empty_catalogue(spark).columns == ["Symbol", "Name"]
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    assert catalogue.read_catalogue(spark, str(tmp_path / "csv"), "csv").columns == ["Symbol", "Name"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalogue.read_catalogue(spark, str(tmp_path / "none"))


def test_bar_files_prune(spark, tmp_path):
    B.write_bars(bars(spark, a=walk(30), b=walk(20)), str(tmp_path / "bars"))
    back = B.read_bars(spark, str(tmp_path / "bars"))
    assert back.count() == 50
    own = B.quote_history(back, "a", "max")
    assert own.count() == 30
    assert "PartitionFilters: [isnotnull(symbol" in own._jdf.queryExecution().executedPlan().toString()
    assert B.quote_history(back, "nothing", "1y").count() == 0


def test_symbol_reaches_the_scan(spark, small):
    plan = B.quote_history(spark.read.parquet(f"{small}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("dt")), "A", "1y")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,A)" in text and "l_comment" not in text


def test_warm_up_rows_suffice(spark):
    df = bars(spark, a=walk(400), b=walk(90, 2))
    whole = indicators(df).where("dt >= '2020-09-01'").select("symbol", "dt", "sma_50", "rsi")
    part = indicators(B.with_warm_up(df, "2020-09-01", 49)).where("dt >= '2020-09-01'").select("symbol", "dt", "sma_50", "rsi")
    assert sorted(whole.collect()) == sorted(part.collect()) and whole.count() > 0


def test_training_logs(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("iter\tRMSE\n0\t0.5\n1\t0.25\n")
    (tmp_path / "l.json").write_text('{"meta": {"launch_mode": "Train", "iteration_count": 2},\n"iterations": [{"learn": [0.5], "iteration": 0, "passed_time": 0.1, "remaining_time": 0.1}, {"learn": [0.25], "iteration": 1, "passed_time": 0.2, "remaining_time": 0}]}')
    assert [tuple(r) for r in training_log.read_metric_log(spark, str(tmp_path / "l.tsv")).orderBy("iter").collect()] == [(0, 0.5), (1, 0.25)]
    assert [(r.iteration, r.learn) for r in training_log.read_training_log(spark, str(tmp_path / "l.json")).orderBy("iteration").collect()] == [(0, 0.5), (1, 0.25)]


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streaming_bars_drop_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate([[(1, at(0, 5), "x", 1.0), (2, at(0, 50), "x", 3.0), (3, at(0, 20), "x", 9.0)], [(4, at(3, 0), "x", 5.0)], [(7, at(4, 0), "x", 5.0)], [(5, at(0, 55), "x", 100.0)], [(6, at(9, 0), "x", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    q = streaming_bars(_stream(spark, tmp_path / "in/*", schema)).writeStream.format("memory").queryName("sb").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    rows = {r.dt.hour: r for r in spark.table("sb").collect()}
    assert tuple(rows[0])[2:] == (1.0, 9.0, 1.0, 3.0, 3.0)


def test_streaming_ewm_goes_on_over_batches(spark, tmp_path):
    schema = "symbol string, dt timestamp, close double"
    closes = [1.0, 4.0, 2.0, 8.0]
    for k in range(2):
        spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 2 * k + i), closes[2 * k + i]) for i in (1, 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    q = streaming_ewm(_stream(spark, tmp_path / "in/*", schema), 3).writeStream.format("memory").queryName("se").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    import pandas as pd

    got = [r.ewm for r in spark.table("se").orderBy("dt").collect()]
    assert got == pytest.approx(pd.Series(closes).ewm(span=3).mean().tolist())
    assert Series().key == "symbol"


def test_streaming_sessions_merge_over_batches(spark, tmp_path):
    """An event between two sessions joins them, one that comes late but within the watermark counts, one beyond it doesn't."""
    schema = "event_id long, ts timestamp, user_id long, value double"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(0, 0), 1, 1.0), (2, at(0, 40), 1, 2.0), (3, at(0, 10), 2, 5.0)], [(4, at(0, 35), 1, 4.0)], [(5, at(6, 0), 1, 8.0)], [(8, at(6, 5), 3, 1.0)], [(6, at(0, 20), 2, 100.0)], [(7, at(12, 0), 1, 0.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    made = streaming_sessions(_stream(spark, tmp_path / "in/*", schema), "36 minutes", "30 minutes")
    q = made.writeStream.format("memory").queryName("ss").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    rows = {(r.user_id, r.started.hour): (r.ended.hour, r.ended.minute, r.n_events, r.highest, r.value) for r in spark.table("ss").collect()}
    assert rows == {(1, 0): (1, 16, 3, 4.0, 7.0), (2, 0): (0, 46, 1, 5.0, 5.0), (1, 6): (6, 36, 1, 8.0, 8.0), (3, 6): (6, 41, 1, 1.0, 1.0)}


def test_decayed_sums_equal_a_loop():
    import numpy as np

    rng = np.random.default_rng(1)
    for q in (0.0, 1e-4, 0.05, 0.5, 0.999):
        x, s, want = rng.normal(size=3000), 2.5, []
        for v in x:
            s = q * s + v
            want.append(s)
        np.testing.assert_allclose(_decayed(x, 2.5, q), want, rtol=1e-9, atol=1e-12)
