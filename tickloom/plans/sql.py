"""DuckDB statements for the same results, written from the definitions: joins over all earlier rows for exponential
means, windows of rows for the rest. Used to check the queries; nothing here runs on Spark."""

from __future__ import annotations

from ..operators.features import FEATURES, LAGS, MOMENTA, WINDOWS

W = "(PARTITION BY symbol ORDER BY dt)"


def r(expr: str, name: str, digits: int | None = 6) -> str:
    return f"{expr} AS {name}" if digits is None else f"round({expr}, {digits}) + 0.0 AS {name}"


def roll(agg: str, c: str, n: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} >= {n} THEN {agg}({c}) OVER {frame} END"


def pct(c: str, k: int) -> str:
    return f"{c} / nullif(lag({c}, {k}) OVER {W}, 0) - 1"


def _ohlc(symbol: str, dt: str, price: str, key: str, volume: str, table: str) -> str:
    return (
        f"SELECT symbol, dt, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(sum(v) AS DOUBLE) AS volume "
        f"FROM (SELECT {symbol} AS symbol, {dt} AS dt, {price} AS p, {key} AS k, {volume} AS v FROM {table}) GROUP BY symbol, dt"
    )


BARS = {
    "lineitem": _ohlc("l_returnflag", "CAST(l_shipdate AS DATE)", "l_extendedprice / l_quantity", "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)", "l_quantity", "lineitem"),
    "orders": _ohlc("c_mktsegment", "CAST(o_orderdate AS DATE)", "o_totalprice", "o_orderkey", "1", "orders JOIN customer ON o_custkey = c_custkey"),
    "events": _ohlc("event_type", "date_trunc('hour', ts)", "value", "event_id", "1", "events"),
}


def _ewm(span: int, c: str) -> str:
    q = repr(1 - 2 / (span + 1))
    return f"sum(y.{c} * pow({q}, x.rn - y.rn)) / sum(pow({q}, x.rn - y.rn))"


BASE = f"""bars AS MATERIALIZED ({BARS['lineitem']}),
b AS MATERIALIZED (SELECT *, row_number() OVER {W} AS rn, close - lag(close) OVER {W} AS move, {pct('close', 1)} AS daily_return FROM bars)"""

EWM = f"""{BASE},
e AS MATERIALIZED (SELECT x.symbol, x.dt, x.rn, {_ewm(12, 'close')} AS ema_12, {_ewm(26, 'close')} AS ema_26 FROM b x JOIN b y ON x.symbol = y.symbol AND y.rn <= x.rn GROUP BY ALL),
mc AS MATERIALIZED (SELECT symbol, dt, rn, ema_12, ema_26, ema_12 - ema_26 AS macd FROM e),
s AS MATERIALIZED (SELECT x.symbol, x.dt, {_ewm(9, 'macd')} AS macd_signal FROM mc x JOIN mc y ON x.symbol = y.symbol AND y.rn <= x.rn GROUP BY x.symbol, x.dt, x.rn)"""

RSI = f"""g AS (SELECT *, CASE WHEN move > 0 THEN move ELSE 0 END AS gain, CASE WHEN move < 0 THEN -move ELSE 0 END AS loss FROM b),
rs AS (SELECT symbol, dt, {roll('avg', 'gain', 14)} AS mg, {roll('avg', 'loss', 14)} AS ml FROM g),
rsi AS (SELECT symbol, dt, CASE WHEN ml = 0 AND mg > 0 THEN 100 ELSE 100 - 100 / (1 + mg / nullif(ml, 0)) END AS rsi FROM rs)"""

IND = f"""{EWM}, {RSI},
ind AS MATERIALIZED (
  SELECT symbol, dt, open, high, low, close, volume, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'close', 200)} AS sma_200,
    ema_12, ema_26, rsi, macd, macd_signal, {roll('avg', 'close', 20)} AS bb_middle,
    {roll('avg', 'close', 20)} + 2 * {roll('stddev_samp', 'close', 20)} AS bb_upper, {roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)} AS bb_lower,
    {roll('avg', 'volume', 20)} AS volume_sma, volume / nullif({roll('avg', 'volume', 20)}, 0) AS volume_ratio, daily_return,
    CASE WHEN daily_return IS NOT NULL THEN product(1 + daily_return) OVER {W} END AS cumulative_return, {pct('close', 10)} AS momentum_10, {pct('close', 20)} AS momentum_20
  FROM b JOIN mc USING (symbol, dt) JOIN s USING (symbol, dt) JOIN rsi USING (symbol, dt)
),
frame AS MATERIALIZED (SELECT * FROM ind WHERE COLUMNS(*) IS NOT NULL)"""

_F = (
    [f"lag(close, {k}) OVER {W} AS price_lag_{k}" for k in LAGS]
    + [f"{roll(f, 'close', n)} AS roll_{name}_{n}" for n in WINDOWS for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
    + [f"{pct('close', k)} AS {kind}_{k}" for k in MOMENTA for kind in ("momentum", "roc")]
    + [f"{pct('volume', 1)} AS volume_change", f"volume / nullif({roll('avg', 'volume', 20)}, 0) AS volume_ratio", "rsi / 100 AS rsi_norm", "macd - macd_signal AS macd_diff", f"lead(close) OVER {W} / nullif(close, 0) - 1 AS target"]
)
FEAT = f"""{IND},
fc AS (SELECT symbol, dt, close, volume, rsi, macd, macd_signal, volume_sma, {', '.join(_F)} FROM frame),
feat AS MATERIALIZED (SELECT * FROM (SELECT symbol, dt, close, {', '.join(FEATURES)}, target FROM fc WHERE COLUMNS(*) IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY symbol) >= 100),
split AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER {W} <= floor(0.8 * count(*) OVER (PARTITION BY symbol)) THEN 'train' ELSE 'test' END AS split FROM feat)"""

DRAW = f"""{IND},
growth AS (SELECT *, product(1 + daily_return) OVER {W} AS growth FROM frame),
peaks AS (SELECT *, max(growth) OVER {W} AS peak FROM growth),
draw AS MATERIALIZED (SELECT *, (growth - peak) / nullif(peak, 0) * 100 AS drawdown FROM peaks)"""

RISK = f"""{DRAW},
p5 AS (SELECT symbol, quantile_cont(daily_return, 0.05) AS p5 FROM draw GROUP BY symbol),
one AS (SELECT symbol, count(*) AS n, avg(daily_return) AS m, stddev_samp(daily_return) AS sd, coalesce(stddev_samp(daily_return) FILTER (WHERE daily_return < 0), 0) AS down,
  min(drawdown) AS max_drawdown, any_value(p5) AS p5, avg(daily_return) FILTER (WHERE daily_return <= p5) AS tail FROM draw JOIN p5 USING (symbol) GROUP BY symbol),
risk AS (SELECT symbol, n AS n_returns, sd * sqrt(252) * 100 AS annual_volatility, CASE WHEN sd > 0 THEN (m * 252 - 0.02) / (sd * sqrt(252)) ELSE 0 END AS sharpe_ratio,
  CASE WHEN down > 0 THEN (m * 252 - 0.02) / (down * sqrt(252)) ELSE 0 END AS sortino_ratio, max_drawdown, p5 * 100 AS var_95, tail * 100 AS cvar_95 FROM one WHERE n >= 30)"""

PROFILE = f"""wd AS (SELECT symbol, isodow(dt) - 1 AS weekday, avg(close) AS m, sum(close) AS t, count(*) AS n FROM frame GROUP BY 1, 2),
season AS (SELECT symbol, stddev_samp(m) / (sum(t) / sum(n)) AS weekly_variation, sum(n) AS n_rows FROM wd GROUP BY symbol),
back AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM frame),
trend AS (SELECT symbol, avg(close) FILTER (WHERE k <= 60) / avg(close) FILTER (WHERE k BETWEEN 201 AND 260) - 1 AS signed_trend FROM back GROUP BY symbol),
vol AS (SELECT symbol, stddev_samp(daily_return) * sqrt(252) AS volatility FROM frame GROUP BY symbol),
profile AS (SELECT symbol, volatility, coalesce(volatility > 0.4, false) AS is_high_volatility, signed_trend, abs(signed_trend) AS trend_strength, coalesce(abs(signed_trend) > 0.15, false) AS has_strong_trend,
  weekly_variation, coalesce(n_rows >= 365 AND weekly_variation > 0.02, false) AS has_seasonality FROM vol LEFT JOIN trend USING (symbol) LEFT JOIN season USING (symbol))"""

PRED = f"""fit AS (SELECT symbol, avg(target) AS mean, regr_slope(target, momentum_5) AS slope, regr_intercept(target, momentum_5) AS icept FROM split WHERE split = 'train' GROUP BY symbol),
wide AS (SELECT symbol, dt, target AS actual, 0.0::DOUBLE AS zero, mean AS train_mean, close / nullif(price_lag_1, 0) - 1 AS persistence, icept + slope * momentum_5 AS one_feature FROM split JOIN fit USING (symbol) WHERE split = 'test'),
pred AS MATERIALIZED (SELECT symbol, dt, model, 'ML' AS type, list_position(['zero', 'train_mean', 'persistence', 'one_feature'], model) - 1 AS ord, actual, predicted
  FROM (UNPIVOT wide ON zero, train_mean, persistence, one_feature INTO NAME model VALUE predicted)),
metrics AS MATERIALIZED (SELECT symbol, model, type, ord, count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse,
  1 - sum(pow(actual - predicted, 2)) / nullif(var_pop(actual) * count(*), 0) AS r2 FROM pred GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r2 DESC NULLS LAST, ord) AS rank FROM metrics)"""

#: Columns that both engines compute alike to the last bit, as they only pick or subtract given values.
_EXACT = ("open", "high", "low", "close", "volume", "price_lag_", "lag_", "roll_min_", "roll_max_", "diff", "highest", "last_close")
_PRICE = ("sma_", "ema_", "macd", "bb_", "volume_sma", "mean_close", "roll_mean_", "roll_std_")


def digits(c: str) -> int | None:
    """Decimals that both engines agree on: fewer for prices, as they are large; None: all of them."""
    named = lambda names: any(c == n or (n.endswith("_") and c.startswith(n)) for n in names)
    return None if named(_EXACT) else 3 if named(_PRICE) or c in ("macd_signal", "macd_diff") else 6


def rounded(*names: str) -> str:
    return ", ".join(r(c, c, digits(c)) for c in names)
