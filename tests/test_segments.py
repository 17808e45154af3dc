"""Scans of blocks, joins by time and selection by histograms: against windows, pandas and brute force; one hot series."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.series import Series
from tickloom.operators import segments
from tickloom.operators.ewm import ewm_means

S = Series("symbol", "at")
SCHEMA = "symbol string, at long, x double"


def ticks(spark, n=3000, seed=1):
    """A hot series, small ones, one of a single row, nulls among values."""
    rng = random.Random(seed)
    rows = [("hot", k * 7 + rng.randrange(7), None if rng.random() < 0.05 else rng.uniform(-0.02, 0.021)) for k in range(n)]
    rows += [(f"s{k % 5}", k, rng.uniform(-0.5, 0.5)) for k in range(200)] + [("one", 5, 0.25), (None, 1, 0.5), (None, 2, 0.25)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def same(a, b, columns):
    rows = [{(r.symbol, r["at"]): r for r in df.select("symbol", "at", *columns).collect()} for df in (a, b)]
    assert rows[0].keys() == rows[1].keys()
    for k, r in rows[0].items():
        for c in columns:
            want = rows[1][k][c]
            assert r[c] is None if want is None else r[c] == pytest.approx(want, rel=1e-9, abs=1e-12), (k, c)


@pytest.fixture(scope="module")
def series(spark):
    return ticks(spark).cache()


def test_blocks_cut_the_hot_series(series):
    b = segments.blocks_of(series, S, rows=200, reach=19)
    sizes = {(r.symbol, r["_block"]): r.n for r in b.sizes.collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) >= 8 and max(hot) < 600 and min(hot) >= 19 and sum(sizes.values()) == series.count()
    assert all(block == 0 for k, block in sizes if k != "hot")
    ends = b.frame.where("symbol = 'hot'").groupBy("_block").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("_block").collect()
    assert all(a.hi < c.lo for a, c in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("rows", [200, 10_000])
def test_scans_equal_windows(series, rows):
    b = segments.blocks_of(series, S, rows=rows, reach=49)
    kinds = {"total": ("sum", "x"), "n": ("count", "x"), "grown": ("product", "x"), "top": ("max", "x"), "low": ("min", "x"), "last": ("last", "x")}
    so_far = S.forward.rowsBetween(Window.unboundedPreceding, 0)
    plain = {name: (F.last("x", ignorenulls=True) if kind == "last" else segments.RUNNING[kind][0](F.col("x"))).over(so_far) for name, (kind, _) in kinds.items()}
    same(segments.running(b, kinds).rows, series.withColumns(plain), list(kinds))
    frames = {"mean": (F.avg, "x", 50), "dev": (F.stddev_samp, "x", 20), "top": (F.max, "x", 3)}
    same(segments.rolling(b, frames).rows, series.withColumns({k: S.rolling(f, c, n) for k, (f, c, n) in frames.items()}), list(frames))
    means = {"fast": ("x", 12), "slow": ("x", 900), "none": ("x", 1)}
    same(segments.ewm(b, means).rows, ewm_means(series, means, S), list(means))
    grown = series.where("x IS NOT NULL").withColumn("growth", S.compounded("x")).withColumn("peak", S.expanding(F.max, "growth")).withColumn("drawdown", (F.col("growth") / F.col("peak") - 1) * 100)
    same(segments.drawdown(b, "x").rows, grown, ["growth", "peak", "drawdown"])


def test_scans_of_a_long_series_use_many_tasks(spark):
    """One series of 10^7 ticks: its blocks are worked on in at least 8 tasks, and their last row is the whole series' result."""
    n = 10_000_000
    long = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("at"), (F.col("id") % 1000 / 1e8).alias("x"))
    b = segments.blocks_of(long, S, rows=1 << 18, reach=9)
    placed = segments.running(b, {"total": ("count", "x"), "top": ("max", "x")}).rows.withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = placed.groupBy("task").agg(F.max("total").alias("total"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len([r for r in out if r.n]) >= 8 and max(r.total for r in out) == n == sum(r.n for r in out)


def test_scans_follow_one_another(series):
    """Returns from the row before, across blocks, and then their drawdown."""
    prices = series.withColumn("price", F.col("x") + 1)
    b = segments.rolling(segments.blocks_of(prices, S, rows=150, reach=1), {"before": (F.first, "price", 2)})
    found = segments.drawdown(b.of(b.frame.withColumn("r", F.col("price") / F.col("before") - 1)), "r").rows
    plain = prices.withColumn("before", S.rolling(F.first, "price", 2)).withColumn("r", F.col("price") / F.col("before") - 1).where("r IS NOT NULL")
    plain = plain.withColumn("growth", S.compounded("r")).withColumn("peak", S.expanding(F.max, "growth")).withColumn("drawdown", (F.col("growth") / F.col("peak") - 1) * 100)
    same(found, plain, ["growth", "peak", "drawdown"])


def test_running_and_drawdown_of_ties_equal_sql(spark):
    """Rows at the very same time share their result, and so do their growth and peak; a row of one block and many blocks."""
    import duckdb

    rng = random.Random(11)
    made = [("hot", k // 3, round(rng.uniform(-1, 1), 2)) for k in range(900)] + [("few", 1, 0.5), ("few", 1, 0.25), ("few", 2, 0.125)]
    rng.shuffle(made)
    df = spark.createDataFrame(made, SCHEMA).repartition(4)
    frame = df.toPandas()  # noqa: F841
    kinds = {"total": ("sum", "x"), "n": ("count", "x"), "top": ("max", "x"), "low": ("min", "x")}
    rows = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found)
    for size in (40, 10_000):
        b = segments.blocks_of(df, S, rows=size)
        out = segments.running(b, kinds).rows.select("symbol", "at", "x", *kinds).collect()
        w = "(PARTITION BY symbol ORDER BY \"at\")"
        assert rows(out) == rows(duckdb.sql(f"SELECT symbol, \"at\", x, sum(x) OVER {w}, count(x) OVER {w}, max(x) OVER {w}, min(x) OVER {w} FROM frame").fetchall())
        out = segments.drawdown(b.of(b.frame.withColumn("r", F.col("x") / 100)), "r").rows.select("symbol", "at", "x", "growth", "peak").collect()
        grown = f"SELECT symbol, \"at\", x, product(1 + x / 100) OVER {w} AS growth FROM frame"
        assert rows(out) == rows(duckdb.sql(f"SELECT *, max(growth) OVER {w} FROM ({grown})").fetchall())


def test_running_sums_of_many_blocks_round_once(spark):
    """Sums of two decimals stay theirs to the last bit that a double has, over 2,000 blocks, next to values beyond doubles' sums."""
    n, rng = 2000, random.Random(12)
    cents = [rng.randrange(10**9, 10**10) for _ in range(n)]
    made = [("a", k, c / 100) for k, c in enumerate(cents)] + [("b", k, x) for k, x in enumerate([1e308, -1e308, float("inf"), 1.0, None])] + [("c", 0, 0.0), ("c", 1, 1e-310), ("d", 0, None)]
    df = spark.createDataFrame(made, SCHEMA)
    table = segments.Blocks(df.withColumn(segments.BLOCK, F.col("at").cast("int")), df.select("symbol", F.col("at").cast("int").alias(segments.BLOCK), F.lit(1).alias("n")), S)
    found = {(r.symbol, r["at"]): r.total for r in segments.running(table, {"total": ("sum", "x")}).rows.collect()}
    total = 0
    for k, c in enumerate(cents):
        total += c
        assert found["a", k] == pytest.approx(total / 100, rel=3e-16)
    assert [found["b", k] for k in range(5)] == [1e308, 0.0, float("inf"), float("inf"), float("inf")]
    assert found["c", 1] == 1e-310 and found["d", 0] is None


def test_lookup_of_blocks_equals_bisection(spark):
    """Rows carry no more than 64 of 4,095 bounds; nulls and series without bounds go to the first block."""
    from bisect import bisect_right

    rng = random.Random(13)
    cuts = {"a": sorted(rng.sample(range(20_000), 4095)), "b": [5], "c": sorted(rng.sample(range(20_000), 128)), None: [3, 9]}
    df = spark.createDataFrame([(k, rng.randrange(-5, 20_005)) for k in (*cuts, "none") for _ in range(2000)] + [("a", None), *((k, x) for k, c in cuts.items() for x in c)], "symbol string, _at long")
    placed = segments._placed(df, spark.createDataFrame(list(cuts.items()), "_bound_key string, _cuts array<bigint>"), S)
    assert placed.columns == ["symbol", "_at", segments.BLOCK]
    assert len(placed.where(F.col(segments.BLOCK) > 3)._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert all(r[segments.BLOCK] == (0 if r["_at"] is None else bisect_right(cuts.get(r.symbol, []), r["_at"])) for r in placed.collect())


def test_rolling_over_many_blocks_keeps_its_plan_small(spark):
    """No list of bounds is looked through row by row in a scan of 300 blocks, and results equal windows of the whole series, ties of equal rows included."""
    df = spark.range(6000).select(F.lit("hot").alias("symbol"), F.floor(F.col("id") / 2).alias("at"), ((F.floor(F.col("id") / 2) * 7919) % 1000 / 100).alias("x"))
    b = segments.blocks_of(df, S, rows=20, reach=9)
    assert b.sizes.count() > 200
    plan = b.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(slice(" not in plan and len(b.frame.where(F.col(segments.BLOCK) > 3)._jdf.queryExecution().optimizedPlan().toString()) < 2 * len(plan) + 2000
    frames = {"mean": (F.avg, "x", 5), "top": (F.max, "x", 10)}
    rows = lambda found: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in found.select("at", *frames).fillna(-1).collect())
    assert rows(segments.rolling(b, frames).rows) == rows(df.withColumns({k: S.rolling(f, c, n) for k, (f, c, n) in frames.items()}))


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    b = segments.blocks_of(none, S, reach=5)
    scans = [segments.running(b, {"t": ("sum", "x")}), segments.rolling(b, {"m": (F.avg, "x", 5)}), segments.ewm(b, {"e": ("x", 5)}), segments.drawdown(b, "x")]
    assert [x.rows.count() for x in scans] == [0] * 4


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_brute_force(spark, strict):
    from tickloom.operators.joins import asof_join

    rng = random.Random(3)
    left = [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([rng.randrange(500), 77, None])) for k in range(800)]
    right = [(s, t, float(t), None if t % 3 else "v") for s in ("a", "b", "d") for t in sorted(rng.sample(range(500), 120))]
    found = asof_join(spark.createDataFrame(left, "k long, symbol string, at long"), spark.createDataFrame(right, "symbol string, at long, price double, note string"), "symbol", "at", strict=strict, rows=40)
    assert found.columns == ["k", "symbol", "at", "at_found", "price", "note"]
    want = set()
    for k, s, t in left:
        fits = [r for r in right if t is not None and r[0] == s and (r[1] < t or not strict and r[1] == t)]
        want.add((k, s, t, *(max(fits, key=lambda r: r[1])[1:] if fits else (None,) * 3)))
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("width", [None, 3.0])
def test_interval_join_against_brute_force(spark, width):
    from tickloom.operators.joins import interval_join

    rng = random.Random(4)
    make = lambda n, top: [(k, rng.choice(["a", "a", "b", None]), lo, lo + rng.choice([0, 1, 2, top])) for k in range(n) for lo in [rng.randrange(-50, 200)]]
    left, right = make(200, 90), make(150, 7)
    pairs = interval_join(spark.createDataFrame(left, "i long, key string, a0 long, a1 long"), spark.createDataFrame(right, "j long, key string, b0 long, b1 long"), ["key"], ("a0", "a1"), ("b0", "b1"), width)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    out = sorted((r.i, r.j) for r in pairs.collect())
    assert out == sorted((i, j) for i, k, a, b in left for j, m, c, d in right if k is not None and k == m and a < b and c < d and a < d and c < b)


@pytest.mark.parametrize("q", [0.05, 0.5, 0.0, 1.0, 0.333])
def test_selection_equals_sorting(spark, q):
    from tickloom.operators.selection import exact_quantile

    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.25, 1e300 * rng.random(), -0.0, 1e-300])) for _ in range(5000)] + [("few", 3.0), ("few", -1.0), ("one", 7.5), ("none", None), ("same", 2.0), ("same", 2.0), (None, 4.0)]
    rows += [("huge", -1.7e308), ("huge", 1.7e308), ("huge", 1.0)]
    found = {r.k: r.value for r in exact_quantile(spark.createDataFrame(rows, "k string, x double").repartition(4), "k", "x", q, gather=20).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted(x for key, x in rows if key == k and x is not None)
        if own:
            at = q * (len(own) - 1)
            lo, hi = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            want[k] = lo + (at - int(at)) * (hi - lo) if at > int(at) else lo
    assert found == want


def test_selection_of_one_key_equals_another_engine(spark):
    """600,000 values of one key: bit for bit what sorting them all gives."""
    import duckdb

    from tickloom.operators.selection import exact_quantile

    values = spark.range(600_000).select(F.lit("a").alias("k"), (F.sin(F.col("id") * 1.7) * F.exp(F.cos("id"))).alias("x"))
    frame = values.toPandas()  # noqa: F841
    assert exact_quantile(values, "k", "x", 0.05).first().value == duckdb.sql("SELECT quantile_cont(x, 0.05) FROM frame").fetchall()[0][0]
