"""The library's queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import annual_volatility, sharpe, sortino
from ..functions.series import Series
from ..operators import evaluate, features, indicators, joins, models, moments, profile, recommend, risk, segments, selection, views
from ..operators.ewm import ewm_means
from ..sources import bars as B
from ..sources import catalogue
from ..sources.scratch import kept
from ..streaming.bars import streaming_bars, streaming_sessions
from . import sql as Q

S = Series()
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, statement: str | None = None) -> None:
    _QUERIES[name] = query
    if statement:
        _SQL[name] = statement


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, to compare with another engine; -0 as 0."""
    return df.select(*((F.round(c, Q.digits(c)) + F.lit(0.0)).alias(c) if t == "double" and Q.digits(c) is not None else F.col(c) for c, t in df.dtypes))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_lineitem(spark, d)


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return indicators.indicator_frame(_bars(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return features.time_split(features.feature_frame(_frame(spark, d)))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.baseline_predictions(_split(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.model_metrics(_predictions(spark, d))


def _over(df_of: Query, change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: tidy(change(df_of(spark, d)))


def _columns(df_of: Query, **made) -> Query:
    """symbol, dt and the columns made, each of a callable without arguments (columns need a session)."""
    return _over(df_of, lambda df: df.select("symbol", "dt", *(c().alias(n) for n, c in made.items())))


def _of(ctes: str, columns: str, table: str, where: str = "") -> str:
    return f"WITH {ctes} SELECT {columns} FROM {table} {where}"


KEY = "symbol, dt"
OHLCV = ("open", "high", "low", "close", "volume")


# --- sources ---
def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    rows = B.read_table(spark, d, "supplier")
    return rows.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("Symbol"), F.col("s_name").alias("Name"))


_SUPPLIERS = "SELECT 'S' || s_suppkey AS Symbol, s_name AS Name FROM supplier"
_add("catalogue_scan", _suppliers, _SUPPLIERS)
_add("catalogue_labels", lambda s, d: catalogue.labels(_suppliers(s, d)).select("label", catalogue.symbol_of("label").alias("symbol")), f"SELECT Symbol || ' - ' || Name AS label, Symbol AS symbol FROM ({_SUPPLIERS}) WHERE Symbol <> '' AND Name <> ''")
_add("catalogue_fallback", lambda s, d: catalogue.read_catalogue(s), "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in catalogue.FALLBACK) + ") t(Symbol, Name)")
_add("catalogue_empty", lambda s, d: catalogue.empty_catalogue(s), "SELECT 'x' AS Symbol, 'x' AS Name WHERE false")
for _name in ("lineitem", "orders", "events"):
    _add(f"bars_{_name}", _over(getattr(B, f"bars_{_name}"), lambda df: df), f"SELECT symbol, dt, {Q.rounded(*OHLCV)} FROM ({Q.BARS[_name]})")
_add("bars_named", lambda s, d: tidy(catalogue.named(_bars(s, d), s.createDataFrame([("A", "Accepted"), ("R", "Returned")], catalogue.SCHEMA))),
     f"SELECT symbol, dt, {Q.rounded(*OHLCV)}, CASE symbol WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' END AS name FROM ({Q.BARS['lineitem']})")
for _period, _months in B.PERIODS.items():
    _since = f"WHERE dt > CAST(last - INTERVAL {_months} MONTH AS DATE)" if _months else ""
    _add(f"quote_history_{_period}", _over(_bars, lambda df, p=_period: B.quote_history(df, "A", p)),
         f"SELECT symbol, dt, {Q.rounded(*OHLCV)} FROM (SELECT *, max(dt) OVER () AS last FROM ({Q.BARS['lineitem']}) WHERE symbol = 'A') {_since}")

# --- windows ---
_add("lags", _columns(_bars, **{f"lag_{k}": (lambda k=k: S.lag("close", k)) for k in features.LAGS}), _of(Q.BASE, f"{KEY}, " + ", ".join(Q.r(f"lag(close, {k}) OVER {Q.W}", f"lag_{k}", None) for k in features.LAGS), "b"))
_add("lead_target", _columns(_bars, target=lambda: F.try_divide(S.lead("close"), F.col("close")) - 1), _of(Q.BASE, f"{KEY}, " + Q.r(f"lead(close) OVER {Q.W} / nullif(close, 0) - 1", "target"), "b"))
_add("diffs", _columns(_bars, diff=lambda: S.diff("close")), _of(Q.BASE, f"{KEY}, " + Q.r("move", "diff", None), "b"))
_add("pct_changes", _columns(_bars, **{f"pct_{k}": (lambda k=k: S.pct_change("close", k)) for k in (1, 5, 10, 20)}), _of(Q.BASE, f"{KEY}, " + ", ".join(Q.r(Q.pct("close", k), f"pct_{k}") for k in (1, 5, 10, 20)), "b"))
for _name, _aggs in {"mean": {"mean": (F.avg, "avg")}, "std": {"std": (F.stddev_samp, "stddev_samp")}, "minmax": {"min": (F.min, "min"), "max": (F.max, "max")}}.items():
    _add(f"rolling_{_name}", _columns(_bars, **{f"roll_{k}_{n}": (lambda f=f, n=n: S.rolling(f, "close", n)) for k, (f, _) in _aggs.items() for n in (5, 10, 20, 50, 200)}),
         _of(Q.BASE, f"{KEY}, " + ", ".join(Q.r(Q.roll(g, "close", n), f"roll_{k}_{n}", Q.digits(f"roll_{k}_{n}")) for k, (_, g) in _aggs.items() for n in (5, 10, 20, 50, 200)), "b"))
_add("row_numbers", _columns(_bars, n=lambda: S.number(), n_from_last=lambda: S.number_from_last()), _of(Q.BASE, f"{KEY}, CAST(rn AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS INTEGER) AS n_from_last", "b"))
_add("expanding_max", _columns(_bars, highest=lambda: S.expanding(F.max, "close")), _of(Q.BASE, f"{KEY}, " + Q.r(f"max(close) OVER {Q.W}", "highest", None), "b"))
_add("ewm_12_26", _over(_bars, lambda df: ewm_means(df, {"ema_12": ("close", 12), "ema_26": ("close", 26)}).select("symbol", "dt", "ema_12", "ema_26")), _of(Q.EWM, f"{KEY}, {Q.rounded('ema_12', 'ema_26')}", "e"))

# --- ticks: scans of blocks of a series, joins by time, selection ---
#: Rows of a block: few, so that small tables have several blocks too. A series has segments.MOST_BLOCKS at most.
TICK_ROWS = 500
_T = "(PARTITION BY symbol ORDER BY dt)"
_TICKS = "t AS MATERIALIZED (SELECT event_type AS symbol, ts AS dt, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events)"


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return B.read_table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("dt"), F.col("value").alias("price"))


def _blocks(spark: SparkSession, d: str, reach: int = 0) -> segments.Blocks:
    return segments.blocks_of(_ticks(spark, d), S, rows=TICK_ROWS, reach=reach)


_RUNS = {"total": ("sum", "price"), "seen": ("count", "price"), "highest": ("max", "price"), "lowest": ("min", "price")}
_add("tick_running", lambda s, d: tidy(segments.running(_blocks(s, d), _RUNS).rows.select("symbol", "dt", *_RUNS)),
     _of(_TICKS, f"{KEY}, {Q.r(f'sum(price) OVER {_T}', 'total')}, count(price) OVER {_T} AS seen, {Q.r(f'max(price) OVER {_T}', 'highest', None)}, {Q.r(f'min(price) OVER {_T}', 'lowest')}", "t"))
_ROLLS = {"roll_mean_30": (F.avg, "price", 30), "roll_std_50": (F.stddev_samp, "price", 50), "roll_max_200": (F.max, "price", 200)}
_add("tick_rolling", lambda s, d: tidy(segments.rolling(_blocks(s, d, 199), _ROLLS).rows.select("symbol", "dt", *_ROLLS)),
     _of(_TICKS, f"{KEY}, {Q.r(Q.roll('avg', 'price', 30), 'roll_mean_30', 3)}, {Q.r(Q.roll('stddev_samp', 'price', 50), 'roll_std_50', 3)}, {Q.r(Q.roll('max', 'price', 200), 'roll_max_200', None)}", "t"))
_add("tick_ewm", lambda s, d: tidy(segments.ewm(_blocks(s, d), {"mean_12": ("price", 12), "mean_200": ("price", 200)}).rows.select("symbol", "dt", "mean_12", "mean_200")),
     _of(f"{_TICKS}, e AS (SELECT x.symbol, x.dt, {Q._ewm(12, 'price')} AS mean_12, {Q._ewm(200, 'price')} AS mean_200 FROM t x JOIN t y ON x.symbol = y.symbol AND y.rn <= x.rn GROUP BY ALL)", f"{KEY}, {Q.rounded('mean_12', 'mean_200')}", "e"))


def _tick_drawdown(spark: SparkSession, d: str) -> DataFrame:
    b = segments.rolling(_blocks(spark, d, 1), {"before": (F.first, "price", 2)})
    # a step's return, made small: raw values jump too far to be compounded
    step = (F.try_divide(F.col("price"), F.col("before")) - 1) / 1000
    return tidy(segments.drawdown(b.of(b.frame.withColumn("r", step)), "r").rows.select("symbol", "dt", "growth", "peak", "drawdown"))


_add("tick_drawdown", _tick_drawdown,
     _of(f"""{_TICKS}, r AS (SELECT symbol, dt, (price / nullif(lag(price) OVER {_T}, 0) - 1) / 1000 AS r FROM t), g AS (SELECT symbol, dt, product(1 + r) OVER {_T} AS growth FROM r WHERE r IS NOT NULL),
p AS (SELECT *, max(growth) OVER {_T} AS peak FROM g)""", f"{KEY}, {Q.rounded('growth', 'peak')}, {Q.r('(growth - peak) / peak * 100', 'drawdown')}", "p"))
_add("tick_tail_risk", lambda s, d: tidy(selection.tail_risk(_ticks(s, d), "price")),
     "SELECT symbol, count(*) AS n_returns, round(any_value(p5) * 100, 6) + 0.0 AS var, round(avg(value) FILTER (WHERE value <= p5) * 100, 6) + 0.0 AS cvar FROM (SELECT event_type AS symbol, value FROM events) JOIN (SELECT event_type AS symbol, quantile_cont(value, 0.05) AS p5 FROM events GROUP BY 1) USING (symbol) GROUP BY symbol")


def _segment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the market segment of their order's customer."""
    lines, placed, who = (B.read_table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    rows = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_mktsegment").alias("symbol"), F.col("l_shipdate").alias("dt"), "l_orderkey", "l_linenumber", "l_quantity")


_add("asof_bars", lambda s, d: tidy(joins.asof_join(_segment_lines(s, d), B.bars_orders(s, d).select("symbol", "dt", "close", "volume"), rows=TICK_ROWS)),
     f"SELECT l.*, b.dt::TIMESTAMP AS dt_found, {Q.rounded('close', 'volume')} FROM (SELECT c_mktsegment AS symbol, l_shipdate AS dt, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) l "
     f"ASOF LEFT JOIN ({Q.BARS['orders']}) b ON l.symbol = b.symbol AND l.dt >= b.dt")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier, the pairs of a returned item in its 30 days of return and an accepted one on its way for a day for each piece."""
    lines = B.read_table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    back = lines.where("l_returnflag = 'R'").select("l_suppkey", F.col("day").alias("r0"), F.date_add("day", 30).alias("r1"))
    out = lines.where("l_returnflag = 'A'").select("l_suppkey", F.col("day").alias("a0"), F.expr("date_add(day, cast(l_quantity as int))").alias("a1"))
    pairs = joins.interval_join(back, out, ["l_suppkey"], ("r0", "r1"), ("a0", "a1"))
    days = F.datediff(F.least("r1", "a1"), F.greatest("r0", "a0"))
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("n_pairs"), F.sum(days).alias("n_days"))


_add("overlapping_shipments", _overlaps,
     """WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d0, CAST(l_shipdate AS DATE) + CASE l_returnflag WHEN 'R' THEN 30 ELSE CAST(l_quantity AS INTEGER) END AS d1, l_returnflag FROM lineitem)
SELECT r.l_suppkey, count(*) AS n_pairs, CAST(sum(least(r.d1, a.d1) - greatest(r.d0, a.d0)) AS BIGINT) AS n_days FROM l r JOIN l a ON r.l_suppkey = a.l_suppkey AND r.d0 < a.d1 AND a.d0 < r.d1
WHERE r.l_returnflag = 'R' AND a.l_returnflag = 'A' GROUP BY r.l_suppkey""")

_add("sliding_bars", lambda s, d: tidy(streaming_bars(B.read_table(s, d, "events"), "2 hours", slide="1 hour").withColumn("dt", F.col("dt").cast("timestamp_ntz"))),
     f"""WITH e AS (SELECT event_id, event_type AS symbol, ts, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS dt FROM events)
SELECT symbol, dt, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM e GROUP BY symbol, dt""")
_add("event_sessions", lambda s, d: streaming_sessions(B.read_table(s, d, "events"), "6 hours").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_events", "highest", F.round("value", 6).alias("value")),
     """WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n_events, max(value) AS highest, round(sum(value), 6) AS value FROM n GROUP BY user_id, session""")

# --- indicators ---
_add("macd", _over(_bars, lambda df: indicators.add_macd(df).select("symbol", "dt", "macd", "macd_signal")), _of(Q.EWM, f"{KEY}, {Q.rounded('macd', 'macd_signal')}", "mc JOIN s USING (symbol, dt)"))
_add("rsi", _over(_bars, lambda df: indicators.add_rsi(df).select("symbol", "dt", "rsi")), _of(f"{Q.BASE}, {Q.RSI}", f"{KEY}, {Q.rounded('rsi')}", "rsi"))
_add("sma", _columns(_bars, **{f"sma_{n}": (lambda n=n: indicators.sma(n)) for n in (20, 50, 200)}), _of(Q.BASE, f"{KEY}, " + ", ".join(Q.r(Q.roll("avg", "close", n), f"sma_{n}", 3) for n in (20, 50, 200)), "b"))
_MID, _DEV = Q.roll("avg", "close", 20), Q.roll("stddev_samp", "close", 20)
_add("bollinger", _over(_bars, lambda df: indicators.add_bollinger(df).select("symbol", "dt", "bb_middle", "bb_upper", "bb_lower")),
     _of(Q.BASE, f"{KEY}, {Q.r(_MID, 'bb_middle', 3)}, {Q.r(f'{_MID} + 2 * {_DEV}', 'bb_upper', 3)}, {Q.r(f'{_MID} - 2 * {_DEV}', 'bb_lower', 3)}", "b"))
_VOL = Q.roll("avg", "volume", 20)
_add("volume_indicators", _over(_bars, lambda df: df.select("symbol", "dt", *(c.alias(n) for n, c in indicators.volume_columns().items()))), _of(Q.BASE, f"{KEY}, {Q.r(_VOL, 'volume_sma', 3)}, {Q.r(f'volume / nullif({_VOL}, 0)', 'volume_ratio')}", "b"))
_add("momentum", _columns(_bars, **{f"momentum_{k}": (lambda k=k: indicators.momentum(k)) for k in features.MOMENTA}), _of(Q.BASE, f"{KEY}, " + ", ".join(Q.r(Q.pct("close", k), f"momentum_{k}") for k in features.MOMENTA), "b"))
_add("daily_return", _columns(_bars, daily_return=lambda: S.pct_change("close")), _of(Q.BASE, f"{KEY}, {Q.rounded('daily_return')}", "b"))
_add("cumulative_return", _over(_bars, lambda df: df.withColumn("r", S.pct_change("close")).select("symbol", "dt", S.compounded("r").alias("cumulative_return"))),
     _of(Q.BASE, f"{KEY}, " + Q.r(f"CASE WHEN daily_return IS NOT NULL THEN product(1 + daily_return) OVER {Q.W} END", "cumulative_return"), "b"))
_add("indicator_frame", _over(_frame, lambda df: df), _of(Q.IND, f"{KEY}, {Q.rounded(*OHLCV, *indicators.INDICATORS)}", "frame"))
_add("warm_up_scan", _over(_bars, lambda df: indicators.indicators(B.with_warm_up(df, "2000-01-01", 199)).where("dt >= '2000-01-01'").select("symbol", "dt", "sma_20", "sma_200")),
     _of(Q.BASE, "*", f"(SELECT {KEY}, {Q.r(Q.roll('avg', 'close', 20), 'sma_20', 3)}, {Q.r(Q.roll('avg', 'close', 200), 'sma_200', 3)} FROM b)", "WHERE dt >= DATE '2000-01-01'"))

# --- features ---
_add("feature_frame", _over(lambda s, d: features.feature_frame(_frame(s, d)), lambda df: df), _of(Q.FEAT, f"{KEY}, {Q.rounded('close', *features.FEATURES, 'target')}", "feat"))
_add("feature_split", _over(_split, lambda df: df.select("symbol", "dt", "split")), _of(Q.FEAT, f"{KEY}, split", "split"))
_add("feature_scaler", _over(_split, lambda df: features.scaler_parameters(df).withColumns({"mean": F.round("mean", 3), "scale": F.round("scale", 3)})),
     _of(Q.FEAT, f"symbol, feature, {Q.r('round(avg(x), 3)', 'mean')}, {Q.r('round(stddev_pop(x), 3)', 'scale')}", f"(UNPIVOT (SELECT symbol, {', '.join(features.FEATURES)} FROM split WHERE split = 'train') ON {', '.join(features.FEATURES)} INTO NAME feature VALUE x)", "GROUP BY symbol, feature"))
_SCALED = ", ".join(Q.r(f"({c} - avg({c}) FILTER (WHERE split = 'train') OVER p) / coalesce(nullif(stddev_pop({c}) FILTER (WHERE split = 'train') OVER p, 0), 1)", c) for c in features.FEATURES)
_add("feature_scaled", lambda s, d: features.scaled(_split(s, d)).select("symbol", "dt", "split", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in features.FEATURES)), _of(Q.FEAT, f"{KEY}, split, {_SCALED}", "split", "WINDOW p AS (PARTITION BY symbol)"))

# --- profile ---
_add("series_profile", _over(_frame, profile.series_profile), _of(f"{Q.IND}, {Q.PROFILE}", f"symbol, {Q.r('volatility', 'volatility')}, is_high_volatility, {Q.rounded('signed_trend', 'trend_strength')}, has_strong_trend, {Q.rounded('weekly_variation')}, has_seasonality", "profile"))
_add("weekday_seasonality", _over(_frame, profile.weekday_means), _of(f"{Q.IND}, {Q.PROFILE}", f"symbol, CAST(weekday AS INTEGER) AS weekday, {Q.r('m', 'mean_close', 3)}", "wd"))
_add("trend_strength", _over(_frame, profile.trend), _of(f"{Q.IND}, {Q.PROFILE}", f"symbol, {Q.r('signed_trend', 'signed_trend')}, {Q.r('abs(signed_trend)', 'trend_strength')}", "trend"))
_add("series_characteristics", _over(_frame, profile.characteristics))
_add("adf_test", lambda s, d: tidy(profile.stationarity(_frame(s, d))))



def _price_moments(spark: SparkSession, d: str) -> DataFrame:
    """The mean products of a unit-root regression's columns with two lags: 1, the close before, the two changes before, the change."""
    seen = profile.dickey_fuller_rows(segments.blocks_of(_bars(spark, d), S, rows=TICK_ROWS, reach=3), "close", 2).rows.where("_seen_at >= 4")
    table = moments.moments(seen.withColumn("row", profile.dickey_fuller_row(F.lit(2), 2)), "symbol", "row")
    cells = table.select("symbol", "n", F.posexplode("moments").alias("at", "x"))
    return cells.select("symbol", "n", F.floor(F.col("at") / 5).cast("int").alias("i"), (F.col("at") % 5).cast("int").alias("j"), (F.round(F.col("x") / F.col("n"), 3) + F.lit(0.0)).alias("product"))


_add("price_moments", _price_moments, _of(Q.BASE, "symbol, count(*) AS n, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(avg(v[i] * v[j]), 3) + 0.0 AS product",
     f"(SELECT symbol, [1, b1, b1 - b2, b2 - b3, close - b1] AS v FROM (SELECT symbol, close, lag(close) OVER {Q.W} AS b1, lag(close, 2) OVER {Q.W} AS b2, lag(close, 3) OVER {Q.W} AS b3 FROM b) WHERE b3 IS NOT NULL), generate_series(1, 5) x(i), generate_series(1, 5) y(j)", "GROUP BY symbol, i, j"))

# --- risk ---
_RISKS = ("annual_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "var_95", "cvar_95")
_add("risk_summary", _over(_frame, risk.risk_profile), _of(Q.RISK, f"symbol, n_returns, {Q.rounded(*_RISKS)}", "risk"))
for _name, _agg, _out in (("sharpe", sharpe, "sharpe_ratio"), ("sortino", sortino, "sortino_ratio"), ("volatility", lambda c: annual_volatility(c) * 100, "annual_volatility")):
    _add(_name, _over(_frame, lambda df, f=_agg, o=_out: df.groupBy("symbol").agg(f(F.col("daily_return")).alias(o))), _of(Q.RISK, f"symbol, {Q.rounded(_out)}", "risk"))
_add("var_cvar", _over(_frame, lambda df: risk.risk_profile(df).select("symbol", "var_95", "cvar_95")), _of(Q.RISK, f"symbol, {Q.rounded('var_95', 'cvar_95')}", "risk"))
_add("max_drawdown", _over(_frame, lambda df: risk.drawdowns(df).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))), _of(Q.RISK, f"symbol, {Q.rounded('max_drawdown')}", "risk"))
_add("drawdown", _over(_frame, lambda df: risk.drawdowns(df).select("symbol", "dt", "growth", "peak", "drawdown")), _of(Q.DRAW, f"{KEY}, {Q.rounded('growth', 'peak', 'drawdown')}", "draw"))
_add("growth_curve", _over(_frame, views.growth_curve), _of(Q.DRAW, f"{KEY}, {Q.r('growth * 100', 'growth')}", "draw"))

# --- evaluation ---
_EVAL = f"{Q.FEAT}, {Q.PRED}"
_add("baseline_predictions", _over(_predictions, lambda df: df), _of(_EVAL, f"{KEY}, model, type, CAST(ord AS INTEGER) AS ord, {Q.rounded('actual', 'predicted')}", "pred"))
_add("paired_predictions", lambda s, d: tidy(evaluate.pair_predictions(_predictions(s, d).drop("actual"), _split(s, d)).select("symbol", "dt", "model", "actual", "predicted")), _of(_EVAL, f"{KEY}, model, {Q.rounded('actual', 'predicted')}", "pred"))
_add("model_metrics", _over(_metrics, lambda df: df), _of(_EVAL, f"symbol, model, type, CAST(ord AS INTEGER) AS ord, n, {Q.rounded('mae', 'rmse', 'r2')}", "metrics"))
_add("champion", _over(_metrics, evaluate.champion), _of(_EVAL, f"symbol, model, type, {Q.rounded('r2', 'rmse', 'mae')}", "ranked", "WHERE rank = 1"))
_TIER = "CASE WHEN r2 > 0.7 THEN 'Excellent' WHEN r2 > 0.4 THEN 'Good' ELSE 'Fair' END AS tier"
_add("leaderboard", _over(_metrics, evaluate.leaderboard), _of(_EVAL, f"symbol, CAST(rank AS INTEGER) AS rank, model, type, 'Machine Learning' AS family, {Q.rounded('r2', 'rmse', 'mae')}, {_TIER}", "ranked", "WHERE rank <= 10"))
_add("prediction_errors", _over(_predictions, evaluate.best_predictions), _of(_EVAL, f"{KEY}, model, {Q.rounded('actual', 'predicted')}, {Q.r('abs(actual - predicted)', 'abs_error')}", "pred SEMI JOIN (SELECT symbol, model FROM ranked WHERE rank = 1) USING (symbol, model)"))
_FIRST = f"(SELECT * FROM pred WHERE ord = 0 QUALIFY row_number() OVER {Q.W} <= 50)"
_add("preview", _over(_predictions, lambda df: evaluate.preview(df).select("symbol", "dt", "model", "actual", "predicted")), _of(_EVAL, f"{KEY}, model, {Q.rounded('actual', 'predicted')}", _FIRST))
_add("preview_metrics", _over(_predictions, evaluate.preview_metrics), _of(_EVAL, f"symbol, model, count(*) AS n, {Q.r('avg(abs(actual - predicted))', 'mae')}, {Q.r('1 - sum(pow(actual - predicted, 2)) / nullif(var_pop(actual) * count(*), 0)', 'r2')}", _FIRST, "GROUP BY symbol, model"))
_add("training_summary", _over(_metrics, evaluate.training_summary), "SELECT * FROM (VALUES ('ML', 4::BIGINT), ('ALL', 4::BIGINT)) t(type, n_models)")


# --- recommendation ---
def _recommendation(spark: SparkSession, d: str) -> DataFrame:
    frame = _frame(spark, d)
    metrics = evaluate.model_metrics(evaluate.baseline_predictions(features.time_split(features.feature_frame(frame))))
    out = recommend.recommend(recommend.recommendation_inputs(risk.risk_profile(frame), metrics, profile.series_profile(frame)))
    return out.select("symbol", "score", "label", "rec_type", "reasoning", "n_models", F.col("n_returns").alias("n_days"))


def rule_sql(table: str) -> str:
    """score, label, rec_type and reasoning of rows with the rules' inputs."""
    return f"""SELECT *, CASE WHEN score IS NULL THEN 'HOLD' WHEN score >= 8 THEN 'STRONG BUY' WHEN score >= 5 THEN 'BUY' WHEN score >= 2 THEN 'HOLD' WHEN score >= -1 THEN 'REDUCE' ELSE 'SELL' END AS label,
  CASE WHEN score IS NULL THEN 'hold' WHEN score >= 5 THEN 'buy' WHEN score >= 2 THEN 'hold' ELSE 'sell' END AS rec_type,
  CASE WHEN score IS NULL THEN 'Insufficient data' ELSE array_to_string(list_filter([
    CASE WHEN best_r2 > 0.7 THEN 'Strong AI prediction (R²=' || printf('%.3f', best_r2) || ')' WHEN best_r2 > 0.4 THEN 'Moderate prediction accuracy' END,
    CASE WHEN sharpe_ratio > 1.5 THEN 'Excellent risk-adjusted returns' END, CASE WHEN sortino_ratio > 1.5 THEN 'Excellent downside protection' END,
    CASE WHEN annual_volatility < 20 THEN 'Low volatility' END, CASE WHEN max_drawdown > -15 THEN 'Strong drawdown control' END,
    CASE WHEN has_strong_trend AND NOT is_high_volatility THEN 'Strong positive trend' END, CASE WHEN is_high_volatility THEN 'High volatility risk' END], lambda x: x IS NOT NULL)[:4], ' | ') END AS reasoning
FROM (SELECT *, CASE WHEN annual_volatility IS NOT NULL AND best_r2 IS NOT NULL THEN CAST(
    CASE WHEN best_r2 > 0.7 THEN 3 WHEN best_r2 > 0.4 THEN 1 ELSE 0 END + CASE WHEN sharpe_ratio > 1.5 THEN 3 WHEN sharpe_ratio > 1 THEN 2 WHEN sharpe_ratio > 0.5 THEN 1 ELSE 0 END
    + CASE WHEN sortino_ratio > 1.5 THEN 2 ELSE 0 END + CASE WHEN annual_volatility < 20 THEN 2 WHEN annual_volatility < 35 THEN 1 ELSE 0 END
    + CASE WHEN max_drawdown > -15 THEN 2 WHEN max_drawdown > -25 THEN 1 ELSE 0 END + CASE WHEN has_strong_trend AND NOT is_high_volatility THEN 2 ELSE 0 END
    - CASE WHEN is_high_volatility THEN 2 ELSE 0 END AS INTEGER) END AS score FROM {table})"""


_add("recommendation", _recommendation, _of(f"{Q.RISK}, {Q.PROFILE}, fc AS (SELECT symbol, dt, close, volume, rsi, macd, macd_signal, volume_sma, {', '.join(Q._F)} FROM frame), " + Q.FEAT.split("fc AS (", 1)[1].split("FROM frame),", 1)[1].lstrip() + f", {Q.PRED}",
     "symbol, score, label, rec_type, reasoning, n_models, n_returns AS n_days", f"({rule_sql('(SELECT * FROM profile LEFT JOIN risk USING (symbol) LEFT JOIN (SELECT symbol, max(r2) AS best_r2, count(DISTINCT model) AS n_models FROM metrics GROUP BY symbol) USING (symbol))')})"))

#: Inputs at and beside the bounds of the rules.
RULE_CASES = [
    (k, *row)
    for k, row in enumerate([
        (0.71, 1.6, 1.6, 19.0, -14.0, True, False), (0.7, 1.5, 1.5, 20.0, -15.0, True, False), (0.41, 1.01, 1.51, 34.9, -24.9, False, False), (0.4, 1.0, 0.0, 35.0, -25.0, False, False),
        (0.2, 0.51, 0.0, 40.0, -30.0, False, False), (0.2, 0.5, 0.0, 40.0, -30.0, False, False), (-1.0, -1.0, -1.0, 80.0, -90.0, True, True), (0.9, 2.0, 2.0, 50.0, -10.0, True, True),
        (None, 2.0, 2.0, 10.0, -10.0, True, False), (0.9, None, None, None, None, False, False), (0.45, 0.6, 1.6, 30.0, -20.0, False, True), (0.71, 0.0, 0.0, 19.9, -14.9, False, False),
    ])
]
_CASE_SCHEMA = "case_id int, best_r2 double, sharpe_ratio double, sortino_ratio double, annual_volatility double, max_drawdown double, has_strong_trend boolean, is_high_volatility boolean"


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::{'INTEGER' if isinstance(x, int) else 'DOUBLE'}"


_CASES = "(SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_literal, c))})" for c in RULE_CASES) + ") t(" + ", ".join(c.split()[0] for c in _CASE_SCHEMA.split(", ")) + "))"
_add("recommendation_rule_cases", lambda s, d: recommend.recommend(s.createDataFrame(RULE_CASES, _CASE_SCHEMA)).select("case_id", "score", "label", "rec_type", "reasoning"), f"SELECT case_id, score, label, rec_type, reasoning FROM ({rule_sql(_CASES)})")

# --- views ---
_HEAD = f"""back AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM frame),
head AS (SELECT symbol, any_value(n) AS n_rows, max(close) FILTER (WHERE k = 1) AS last_close, max(close) FILTER (WHERE k = 2) AS prev, max(close) FILTER (WHERE k = least(252, n)) AS base,
  max(volume) FILTER (WHERE k = 1) AS v, max(rsi) FILTER (WHERE k = 1) AS last_rsi, avg(volume) FILTER (WHERE k <= 20) AS mv FROM back GROUP BY symbol)"""
_add("header_metrics", _over(_frame, views.header_metrics),
     _of(f"{Q.IND}, {_HEAD}", f"symbol, n_rows, last_close, {Q.r('(last_close / prev - 1) * 100', 'change_percent')}, coalesce(last_close >= prev, false) AS is_up, {Q.r('(last_close / base - 1) * 100', 'trailing_return')}, {Q.r('v / 1e6', 'volume_millions')}, {Q.r('last_rsi', 'last_rsi')}, "
         f"CASE WHEN last_rsi > 70 THEN 'Overbought' WHEN last_rsi < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_band, {Q.r('v / mv', 'volume_ratio')}", "head"))
_TAIL = "(SELECT * FROM frame QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 200)"
_add("price_panel", _over(_frame, views.price_panel), _of(Q.IND, f"{KEY}, {Q.rounded('open', 'high', 'low', 'close', 'bb_upper', 'bb_lower', 'sma_20', 'sma_50')}", _TAIL))
_add("macd_panel", _over(_frame, views.macd_panel), _of(Q.IND, f"{KEY}, {Q.rounded('macd', 'macd_signal')}", _TAIL))
_add("volume_panel", _over(_frame, views.volume_panel), _of(Q.IND, f"{KEY}, {Q.rounded('volume')}, close >= open AS is_up", _TAIL))


# --- models, with their presets ---
def _modelled(predict: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: predict(features.scaled(_split(s, d)))


_add("rf_predictions", _modelled(lambda df: models.fit_predict(df, "random_forest")))
for _k, _name in enumerate(models.BOOSTED, 1):
    _add(f"{_name}_predictions", _modelled(lambda df, n=_name, k=_k: models.fit_predict(df, n, ord_=k)))
for _k, _name in enumerate(models.GROWN, 2):
    _add(f"{_name}_predictions", _modelled(lambda df, n=_name, k=_k: models.fit_predict(df, n, ord_=k)))
_add("svr_rff_predictions", _modelled(lambda df: models.kernel_predict(df, ord_=5)))
for _k, _name in enumerate(models.NETWORKS, 6):
    _add(f"network_{_name}_predictions", _modelled(lambda df, n=_name, k=_k: models.network_predict(df, n, ord_=k)))
for _k, _name in enumerate(models.ORDERS, 11):
    _add(f"{_name}_forecast", lambda s, d, n=_name, k=_k: models.arima_predict(_split(s, d), n, ord_=k))


def _zoo_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all models, and of the closed-form ones. Features are written once, and each model's predictions."""
    split = kept(_split(spark, d), "split")
    data = kept(features.scaled(split), "scaled")
    fits = [lambda n=n, k=k: models.fit_predict(data, n, ord_=k) for k, n in enumerate(("random_forest", *models.BOOSTED), 4)]
    fits += [lambda: models.kernel_predict(data, ord_=9)]
    fits += [lambda n=n, k=k: models.network_predict(data, n, ord_=k) for k, n in enumerate(models.NETWORKS, 10)]
    fits += [lambda n=n, k=k: models.arima_predict(split, n, ord_=k) for k, n in enumerate(models.ORDERS, 15)]
    return evaluate.model_metrics(evaluate.merged(evaluate.baseline_predictions(split), *models.together(fits)))


def _zoo(spark: SparkSession, d: str) -> DataFrame:
    """All models on one leaderboard."""
    return tidy(evaluate.leaderboard(_zoo_metrics(spark, d)))


_add("model_zoo_leaderboard", _zoo)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
