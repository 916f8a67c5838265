"""The registered queries as SQL over the same tables.

A query is the text of its result plus the named subqueries it mentions, which are pulled
in with their own dependencies. ``_shown`` formats the result as the queries do.
"""

from __future__ import annotations

import re

LAGS = [1, 5, 10, 15, 20]
DEFAULT = ["price_to_ma20", "ma_cross", "rsi14", "macd_norm", "limit_up"]
BAR = "time, symbol, open, high, low, close, volume, amount"
WINDOW = "PARTITION BY symbol ORDER BY time"


def _symbol(key: str) -> str:
    digits = f"CAST({key} AS VARCHAR)"
    return (f"CASE WHEN length({digits}) < 6 THEN lpad({digits}, 6, '0') ELSE {digits} END "
            f"|| CASE WHEN {key} % 2 = 0 THEN '.SZ' ELSE '.SH' END")


def _sma(column: str, rows: int, window: str = WINDOW) -> str:
    frame = f"OVER ({window} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {rows} THEN avg({column}) {frame} END"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN NOT isnan(corr({y}, {x})) THEN round(corr({y}, {x}), 12) END"


def _limit(prev: str) -> str:
    return f"round(CAST({prev} AS DECIMAL(12, 4)) * 1.1, 2)"


def _code(symbol: str) -> str:
    return f"split_part({symbol}, '.', 2) || split_part({symbol}, '.', 1)"


def _ewm(column: str, alpha: str, seed: int = 0) -> str:
    """The weighted sum a seeded recursion unrolls to, for row ``t`` over its rows ``s``."""
    weight = f"CASE WHEN s.rn = {seed} THEN 1 ELSE {alpha}::DOUBLE END"
    return f"sum(pow(1 - {alpha}::DOUBLE, t.rn - s.rn) * {weight} * s.{column})"


_ROLL = "arg_min(open, time) AS open, max(high) AS high, min(low) AS low, " \
        "arg_max(close, time) AS close, sum(volume) AS volume, sum(amount) AS amount"


def _minute_roll(minutes: int, source: str) -> str:
    return (f"SELECT time_bucket(INTERVAL {minutes} MINUTE, time) AS bucket, symbol, {_ROLL} "
            f"FROM {source} GROUP BY 1, 2")


def _unpivot(names: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT time, symbol, '{n}' AS factor_name, {n} AS factor_value FROM {source} "
        f"WHERE {n} IS NOT NULL" for n in names)


CTES = {
    "ticks": f"""
        SELECT l_shipdate AS time, {_symbol('l_suppkey')} AS symbol,
               round(100 * (1 + l_discount - l_tax), 2) AS price, l_quantity AS quantity,
               struct_pack(a := l_orderkey, b := l_linenumber, c := l_discount, d := l_tax) AS k
        FROM lineitem""",
    "raw": """
        SELECT time, symbol, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, k) AS close, CAST(sum(quantity) AS BIGINT) AS volume,
               sum(price * quantity) AS amount
        FROM ticks GROUP BY time, symbol""",
    "bars": f"""
        SELECT *, 100 * (close / lag(close) OVER ({WINDOW}) - 1) AS pct_change,
               lag(close) OVER ({WINDOW}) AS prev_close,
               row_number() OVER ({WINDOW}) - 1 AS rn
        FROM raw""",
    "stocks": f"""
        SELECT {_symbol('s_suppkey')} AS symbol, s_name AS name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'SZ' ELSE 'SH' END AS exchange,
               CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS is_st
        FROM supplier""",
    "exported": """
        SELECT time, symbol, open, high, low, close, volume, 1.0 AS factor,
               coalesce(pct_change, 0.0) AS change
        FROM bars WHERE open IS NOT NULL""",
    "moves": """
        SELECT *, greatest(coalesce(close - prev_close, 0), 0) AS gain,
               greatest(coalesce(prev_close - close, 0), 0) AS loss FROM bars""",
    "ewms": f"""
        SELECT t.symbol, t.rn, any_value(t.time) AS time, any_value(t.close) AS close,
               {_ewm('gain', '(1 / 14.0)')} AS avg_gain, {_ewm('loss', '(1 / 14.0)')} AS avg_loss,
               {_ewm('close', '(2 / 13.0)')} AS ema_fast, {_ewm('close', '(2 / 27.0)')} AS ema_slow
        FROM moves t JOIN moves s ON s.symbol = t.symbol AND s.rn <= t.rn
        GROUP BY t.symbol, t.rn""",
    "macds": "SELECT symbol, rn, ema_fast - ema_slow AS macd FROM ewms WHERE rn >= 25",
    "macd_signals": f"""
        SELECT t.symbol, t.rn, {_ewm('macd', '0.2', 25)} AS macd_signal
        FROM macds t JOIN macds s ON s.symbol = t.symbol AND s.rn <= t.rn
        GROUP BY t.symbol, t.rn""",
    "smas": f"""
        SELECT *, {_sma('close', 20)} AS ma20, {_sma('close', 60)} AS ma60,
               CASE WHEN prev_close IS NOT NULL AND high IS NOT NULL
                    THEN CASE WHEN CAST(high AS DECIMAL(12, 4)) >= {_limit('prev_close')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               END AS limit_up
        FROM bars""",
    "sma_factors": """
        SELECT *, (close - ma20) / nullif(ma20, 0) AS price_to_ma20,
               (ma20 - ma60) / nullif(ma60, 0) AS ma_cross FROM smas""",
    "rsis": """
        SELECT symbol, rn, CASE WHEN rn >= 13 THEN
                 CASE WHEN avg_loss = 0 THEN 100 ELSE 100 - 100 / (1 + avg_gain / avg_loss) END
               END AS rsi14
        FROM ewms""",
    "features": """
        SELECT f.*, r.rsi14, m.macd,
               CASE WHEN f.rn >= 33 THEN (m.macd - g.macd_signal) / nullif(f.close, 0) END AS macd_norm
        FROM sma_factors f JOIN rsis r USING (symbol, rn)
        LEFT JOIN macds m USING (symbol, rn) LEFT JOIN macd_signals g USING (symbol, rn)""",
    "factors": _unpivot(DEFAULT, "features"),
    "fwd": " UNION ALL ".join(
        f"SELECT time, symbol, {n} AS lag, lead(pct_change, {n}) OVER ({WINDOW}) AS fwd_ret FROM bars"
        for n in LAGS),
    "pairs": """
        SELECT f.*, w.lag, w.fwd_ret FROM factors f JOIN fwd w USING (time, symbol)
        WHERE isfinite(f.factor_value) AND isfinite(w.fwd_ret)""",
    "ranked": """
        SELECT *,
               rank() OVER (PARTITION BY lag, factor_name, time ORDER BY factor_value)
               + (count(*) OVER (PARTITION BY lag, factor_name, time, factor_value) - 1) / 2.0::DOUBLE AS rx,
               rank() OVER (PARTITION BY lag, factor_name, time ORDER BY fwd_ret)
               + (count(*) OVER (PARTITION BY lag, factor_name, time, fwd_ret) - 1) / 2.0::DOUBLE AS ry
        FROM pairs""",
    "daily": f"""
        SELECT lag, factor_name, time, {_corr('factor_value', 'fwd_ret')} AS ic,
               {_corr('rx', 'ry')} AS rank_ic, count(*) AS n_stocks
        FROM ranked GROUP BY lag, factor_name, time""",
    "summary": """
        SELECT *, mean_ic / nullif(ic_std, 0) AS ic_ir,
               mean_rank_ic / nullif(rank_ic_std, 0) AS rank_ic_ir,
               mean_ic / nullif(ic_std, 0) * sqrt(n_days) AS t_stat
        FROM (SELECT lag, factor_name, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std,
                     avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS rank_ic_std,
                     avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END) AS win_rate,
                     count(ic) AS n_days
              FROM daily GROUP BY lag, factor_name)""",
    "study": f"""
        SELECT b.*, {_limit('prev_close')} AS limit_up_price,
               CASE WHEN CAST(high AS DECIMAL(12, 4)) >= {_limit('prev_close')} THEN 1 ELSE 0 END AS is_limit_up
        FROM bars b LEFT JOIN stocks s USING (symbol)
        WHERE coalesce(s.is_st, 0) = 0 AND prev_close > 0 AND high IS NOT NULL""",
    "study_next": f"""
        SELECT * FROM (SELECT *, lead(pct_change) OVER ({WINDOW}) AS next_ret FROM study)
        WHERE next_ret IS NOT NULL""",
    "study_daily": f"""
        SELECT * FROM (
          SELECT time, {_corr('is_limit_up', 'next_ret')} AS ic, {_corr('rx', 'ry')} AS rank_ic,
                 count(*) AS n_stocks
          FROM (SELECT *,
                  rank() OVER (PARTITION BY time ORDER BY is_limit_up)
                  + (count(*) OVER (PARTITION BY time, is_limit_up) - 1) / 2.0::DOUBLE AS rx,
                  rank() OVER (PARTITION BY time ORDER BY next_ret)
                  + (count(*) OVER (PARTITION BY time, next_ret) - 1) / 2.0::DOUBLE AS ry
                FROM study_next)
          GROUP BY time)
        WHERE ic IS NOT NULL AND rank_ic IS NOT NULL""",
    "crossed": f"""
        SELECT *, lag(ma20) OVER ({WINDOW}) AS p20, lag(ma60) OVER ({WINDOW}) AS p60
        FROM (SELECT f.time, f.symbol, f.ma20, f.ma60, r.rsi14
              FROM sma_factors f JOIN rsis r USING (symbol, rn)
              WHERE f.ma20 IS NOT NULL AND f.ma60 IS NOT NULL AND r.rsi14 IS NOT NULL)""",
    "signals": """
        SELECT time, symbol, 'momentum_v1' AS strategy,
               CASE WHEN ma20 > ma60 AND p20 <= p60 AND rsi14 < 70 THEN 1
                    WHEN ma20 < ma60 AND p20 >= p60 THEN -1
                    WHEN rsi14 > 80 THEN -1 ELSE 0 END AS signal,
               ma20 - ma60 AS score, CAST(NULL AS VARCHAR) AS metadata
        FROM crossed""",
    "returns": f"""
        SELECT * FROM (
          SELECT time, symbol, strategy,
                 lag(signal) OVER ({WINDOW}) * pct_change / 100 AS strategy_ret
          FROM signals JOIN bars USING (time, symbol))
        WHERE strategy_ret IS NOT NULL""",
    "curves": f"""
        SELECT *, (equity - peak) / peak AS drawdown FROM (
          SELECT *, max(equity) OVER ({WINDOW} ROWS UNBOUNDED PRECEDING) AS peak FROM (
            SELECT *, product(1 + strategy_ret) OVER ({WINDOW} ROWS UNBOUNDED PRECEDING) AS equity
            FROM returns))""",
    "chosen": """
        SELECT time, symbol FROM signals
        QUALIFY row_number() OVER (PARTITION BY time ORDER BY score DESC, symbol) <= 3""",
    # An order is what was chosen at the bar before; the position is the last order that was filled.
    "orders": """
        SELECT b.time, b.symbol, b.pct_change, coalesce(abs(b.pct_change) >= 9.5, false) AS blocked,
               lag(c.symbol IS NOT NULL, 1, false) OVER (PARTITION BY b.symbol ORDER BY b.time) AS want
        FROM bars b LEFT JOIN chosen c ON c.time = b.time AND c.symbol = b.symbol""",
    "fills": """
        SELECT o.time, o.symbol, o.pct_change, coalesce(f.want, false) AS held
        FROM orders o ASOF LEFT JOIN (SELECT symbol, time, want FROM orders WHERE NOT blocked) f
          ON f.symbol = o.symbol AND f.time <= o.time""",
    "trades": """
        SELECT *, lag(held, 1, false) OVER (PARTITION BY symbol ORDER BY time) AS had FROM fills""",
    "topk": """
        SELECT time, count(*) FILTER (WHERE held) AS n_held,
               sum(CASE WHEN held THEN coalesce(pct_change, 0) / 100 ELSE 0 END)
                 / greatest(3, count(*) FILTER (WHERE held)) AS gross_ret,
               sum(CASE WHEN held AND NOT had THEN 0.0005::DOUBLE
                        WHEN had AND NOT held THEN 0.0015::DOUBLE ELSE 0 END) / 3 AS cost
        FROM trades WHERE held OR had
        GROUP BY time""",
    "net": "SELECT *, gross_ret - cost AS strategy_ret FROM topk",
    "weekly_bars": f"SELECT date_trunc('week', time) AS bucket, symbol, {_ROLL} FROM raw GROUP BY 1, 2",
    "monthly_bars": f"SELECT date_trunc('month', time) AS bucket, symbol, {_ROLL} FROM raw GROUP BY 1, 2",
    "event_bars": """
        SELECT ts AS time, event_type AS symbol, value AS open, value AS high, value AS low,
               value AS close, 1 AS volume, value AS amount FROM events""",
    "five": "SELECT bucket AS time, * EXCLUDE (bucket) FROM (" + _minute_roll(5, "event_bars") + ")",
    "days": "SELECT DISTINCT time FROM raw",
    "long2": _unpivot(["price_to_ma20", "ma_cross"], "sma_factors"),
    "warm_bars": f"""
        SELECT time, symbol, close, lag(close) OVER ({WINDOW}) AS prev_close,
               row_number() OVER ({WINDOW}) - 1 AS rn,
               {_sma('close', 20)} AS ma20, {_sma('close', 60)} AS ma60
        FROM raw
        WHERE time >= (SELECT min(time) FROM days WHERE time >= '2001-01-01') - INTERVAL 90 DAY""",
    "warm_moves": """
        SELECT *, greatest(coalesce(close - prev_close, 0), 0) AS gain,
               greatest(coalesce(prev_close - close, 0), 0) AS loss FROM warm_bars""",
    "warm_rsis": f"""
        SELECT t.symbol, t.rn, {_ewm('gain', '(1 / 14.0)')} AS avg_gain,
               {_ewm('loss', '(1 / 14.0)')} AS avg_loss
        FROM warm_moves t JOIN warm_moves s ON s.symbol = t.symbol AND s.rn <= t.rn
        GROUP BY t.symbol, t.rn""",
    "warm_factors": """
        SELECT b.*, (close - ma20) / nullif(ma20, 0) AS price_to_ma20,
               (ma20 - ma60) / nullif(ma60, 0) AS ma_cross,
               CASE WHEN rn >= 13 THEN CASE WHEN avg_loss = 0 THEN 100
                    ELSE 100 - 100 / (1 + avg_gain / avg_loss) END END AS rsi14
        FROM warm_bars b JOIN warm_rsis USING (symbol, rn)""",
    "base_bars": f"""
        SELECT {BAR}, pct_change, 2.5 AS adj_factor, true AS is_st, false AS is_suspended
        FROM bars WHERE day(time) % 6 <> 3""",
    "new_bars": f"""
        SELECT time, symbol, open, high, low, close, volume + 1 AS volume, amount, pct_change
        FROM bars WHERE day(time) % 3 = 0""",
    "bar_versions": """
        SELECT *, 0 AS version FROM base_bars UNION ALL BY NAME SELECT *, 1 AS version FROM new_bars""",
    "stored_bars": """
        SELECT time, symbol, arg_max(open, version) AS open, arg_max(high, version) AS high, arg_max(low, version) AS low,
               arg_max(close, version) AS close, arg_max(volume, version) AS volume, arg_max(amount, version) AS amount,
               CASE WHEN max(version) = 0 THEN max(pct_change) ELSE max(pct_change) FILTER (version = 1) END AS pct_change,
               max(adj_factor) AS adj_factor, coalesce(bool_or(is_st), false) AS is_st,
               coalesce(bool_or(is_suspended), false) AS is_suspended
        FROM bar_versions GROUP BY time, symbol""",
    "in_time": """
        SELECT * FROM raw WHERE day(time) % 10 <> 7
          OR time > (SELECT max(time) FROM raw WHERE day(time) % 10 <> 7) - INTERVAL 7 DAY""",
    "in_time_weeks": f"SELECT date_trunc('week', time) AS bucket, symbol, {_ROLL} FROM in_time GROUP BY 1, 2",
}


def _metrics(source: str, by: str, ret: str = "strategy_ret", order: str = "time",
             periods: int = 252) -> str:
    """Risk figures of a return table per group."""
    window = f"(PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""
        SELECT {by}, round(yr, 4) + 0 AS annualized_return, round(vol, 4) + 0 AS annualized_vol,
               round(CASE WHEN vol = 0 THEN 0 ELSE yr / vol END, 4) + 0 AS sharpe,
               round(dd, 4) + 0 AS max_drawdown,
               round(CASE WHEN dd = 0 THEN 0 ELSE yr / abs(dd) END, 4) + 0 AS calmar
        FROM (SELECT {by}, pow(product(1 + {ret}), {periods}::DOUBLE / count(*)) - 1 AS yr,
                     stddev_pop({ret}) * sqrt({periods}) AS vol, min((eq - pk) / pk) AS dd
              FROM (SELECT *, max(eq) OVER {window} AS pk
                    FROM (SELECT *, product(1 + {ret}) OVER {window} AS eq FROM {source}))
              GROUP BY {by})"""


def _metric_rows(source: str, value: str) -> str:
    names = ["annualized_return", "annualized_vol", "sharpe", "max_drawdown", "calmar"]
    return " UNION ALL ".join(
        f"SELECT strategy, '{n}' AS metric, {n} AS {value} FROM ({source})" for n in names)


# The evaluation of stored tables, where returns have four decimals.
CTES["stored_returns"] = "SELECT * REPLACE (round(pct_change, 4) AS pct_change) FROM bars"
CTES |= {f"stored_{name}": re.sub(r"\b(fwd|pairs|ranked|daily)\b", r"stored_\1",
                                  re.sub(r"\bbars\b", "stored_returns", CTES[name]))
         for name in ("fwd", "pairs", "ranked", "daily", "summary")}

_FORMATS = {
    "d": "strftime({c}, '%Y-%m-%d')",
    "m": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
    "f": "round(CAST({c} AS DOUBLE), 6) + 0",
    "i": "CAST({c} AS BIGINT)",
    "s": "{c}",
}


def _shown(columns: str, body: str) -> str:
    """``columns`` lists ``name:format``; the body may use any named subquery."""
    items = [c.rsplit(":", 1) for c in columns.split()]
    select = ", ".join(f"{_FORMATS[f].format(c=n)} AS {n}" for n, f in items)
    needed: list[str] = []
    text = body
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, name)
            text += CTES[name]
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    return f"WITH {ctes}\nSELECT {select} FROM ({body})" if needed else f"SELECT {select} FROM ({body})"


_OHLCV = "time:d symbol:s open:f high:f low:f close:f volume:i amount:f"
_MINUTE = _OHLCV.replace("time:d symbol:s", "time:m symbol:s freq:s")
_BARS = _OHLCV + " pct_change:f"
_FLAGS = " adj_factor:f is_st:s is_suspended:s"
_LONG = "time:d symbol:s factor_name:s factor_value:f"
_DAILY = "time:d lag:i factor_name:s ic:f rank_ic:f n_stocks:i"
_SUMMARY = ("lag:i factor_name:s mean_rank_ic:f rank_ic_std:f rank_ic_ir:f mean_ic:f ic_std:f "
            "ic_ir:f t_stat:f win_rate:f n_days:i")
_SIGNAL = "time:d symbol:s strategy:s signal:i score:f metadata:s"
_METRIC = "annualized_return:f annualized_vol:f sharpe:f max_drawdown:f calmar:f"


def _window(columns: str, source: str = "bars") -> str:
    return f"SELECT time, symbol, {columns} FROM {source}"


def _one_factor(name: str, source: str) -> str:
    return _shown(_LONG, _unpivot([name], source))


_ROLLED = "SELECT bucket AS time, symbol, open, high, low, close, volume, amount FROM "
_GRID = """
    SELECT g.time, lower(""" + _code("g.symbol") + """) AS instrument, e.open, e.high, e.low, e.close,
           e.volume, e.factor, e.change
    FROM (SELECT DISTINCT d.time, e.symbol FROM days d, (SELECT DISTINCT symbol FROM exported) e) g
    LEFT JOIN exported e ON e.time = g.time AND e.symbol = g.symbol"""


def _histogram(source: str, column: str, bins: int, lo: str, hi: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""
        SELECT {group}bin, any_value(lo) + bin * any_value(hi - lo) / {bins} AS "left",
               count(*) AS count, count(*) / (any_value(n) * any_value(hi - lo) / {bins}) AS density
        FROM (SELECT *, count(*) OVER ({f'PARTITION BY {by}' if by else ''}) AS n,
                     least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) AS bin
              FROM (SELECT *, {lo} AS lo, {hi} AS hi FROM {source})
              WHERE {column} BETWEEN lo AND hi)
        GROUP BY {group}bin"""


ORACLE = {
    "bars_daily": _shown(_BARS, "SELECT * FROM bars"),
    "normalize_bars": _shown(_BARS, "SELECT * FROM bars"),
    "scan_symbol": _shown(_BARS, """SELECT * FROM bars WHERE symbol = '000001.SH'
        AND time BETWEEN '1996-01-01' AND '1998-12-31'"""),
    "scan_dates": _shown(_BARS, """SELECT * FROM bars
        WHERE time IN ('1996-03-04', '1997-06-05', '2050-01-01')"""),
    "load_panel_range": _shown("time:d symbol:s open:f high:f low:f close:f pct_change:f",
        "SELECT * FROM bars WHERE time >= '1996-01-01' AND time < '1997-01-01'"),
    "returns_padded": _shown("time:d symbol:s pct_change:f", """SELECT * FROM bars
        WHERE time BETWEEN '1998-01-01' AND DATE '1998-06-30' + INTERVAL 45 DAY"""),
    "latest_n": _shown(_BARS, """SELECT * FROM bars WHERE symbol = '000001.SH'
        ORDER BY time DESC LIMIT 20"""),
    "head_tail": _shown(_BARS + " part:s", """
        (SELECT *, 'head' AS part FROM bars ORDER BY time, symbol LIMIT 5) UNION ALL
        (SELECT *, 'tail' AS part FROM bars ORDER BY time DESC, symbol DESC LIMIT 5)"""),
    "sql_query": _shown("time:d symbol:s close:f volume:i", """SELECT * FROM raw
        WHERE symbol = '000002.SZ' AND close > 100 ORDER BY time DESC LIMIT 50"""),
    "stocks_dimension": _shown("symbol:s name:s exchange:s is_st:i", "SELECT * FROM stocks"),
    "index_bars": _shown("time:d symbol:s pct_change:f", """
        SELECT time, '000300.SH' AS symbol, avg(pct_change) AS pct_change FROM bars
        GROUP BY time HAVING avg(pct_change) IS NOT NULL"""),
    "export_scan": _shown(
        "time:d symbol:s open:f high:f low:f close:f volume:i adj_factor:f pct_change:f",
        "SELECT *, factor AS adj_factor, change AS pct_change FROM exported"),
    "derived_columns": _shown(
        "time:d symbol:s change:f spread:f range_pct:f source:s note:s volume:f", """
        SELECT time, symbol, pct_change AS change, high - low AS spread,
               (high - low) / nullif(open, 0) AS range_pct, 'bars' AS source,
               CAST(NULL AS VARCHAR) AS note, volume FROM bars"""),
    "universe_filter": _shown("time:d symbol:s close:f", """SELECT * FROM raw
        WHERE symbol IN (SELECT symbol FROM stocks WHERE exchange = 'SZ')"""),
    "missing_values": _shown(
        "n_rows:i n_present:i n_finite:i n_complete:i sum_nan_zero:f n_after_nan_null:i "
        "sum_null_zero:f", """
        SELECT count(*) AS n_rows, count(*) FILTER (WHERE volume <= 50) AS n_present,
               count(*) FILTER (WHERE open <= 108) AS n_finite,
               count(*) FILTER (WHERE volume <= 50 AND pct_change IS NOT NULL) AS n_complete,
               sum(CASE WHEN volume <= 50 THEN close ELSE 0 END) AS sum_nan_zero,
               count(*) FILTER (WHERE volume <= 50) AS n_after_nan_null,
               sum(coalesce(pct_change, 0)) AS sum_null_zero FROM bars"""),
    "drop_missing": _shown("time:d symbol:s ma20:f ma60:f rsi14:f", """
        SELECT f.time, f.symbol, f.ma20, f.ma60, r.rsi14 FROM smas f JOIN rsis r USING (symbol, rn)
        WHERE f.ma60 IS NOT NULL AND f.ma20 IS NOT NULL AND r.rsi14 IS NOT NULL"""),
    "scalar_functions": _shown(
        "time:d symbol:s code:s code_lower:s day_text:s day_parsed:d iso:s naive_day:d "
        "warmup_start:d week:d month:d ratio4:f next_limit:f root_volume:f move:f squared:f", f"""
        SELECT time, symbol, {_code('symbol')} AS code, lower({_code('symbol')}) AS code_lower,
               strftime(time, '%Y%m%d') AS day_text, time AS day_parsed,
               strftime(time, '%Y-%m-%d') AS iso, time AS naive_day,
               time - INTERVAL 90 DAY AS warmup_start, date_trunc('week', time) AS week,
               date_trunc('month', time) AS month, round(close / open, 4) AS ratio4,
               {_limit('close')} AS next_limit, sqrt(volume) AS root_volume,
               abs(close - open) AS move, pow(close / 100, 2) AS squared FROM bars"""),
    "json_metadata": _shown("time:d symbol:s metadata:s", """
        SELECT time, symbol, CASE WHEN volume > 25 THEN '{"volume":' || volume || '}' ELSE '{}' END AS metadata
        FROM raw"""),
    "error_texts": _shown("exchange:s first_errors:s", """
        SELECT exchange, string_agg(symbol, '; ' ORDER BY symbol) AS first_errors
        FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY symbol) AS n
              FROM stocks WHERE is_st = 1) WHERE n <= 5 GROUP BY exchange"""),
    "symbol_list": _shown("symbol:s", "SELECT DISTINCT symbol FROM raw"),
    "symbol_count": _shown("n_symbols:i", "SELECT count(DISTINCT symbol) AS n_symbols FROM raw"),
    "trading_calendar": _shown("trade_date:s",
        "SELECT DISTINCT strftime(time, '%Y%m%d') AS trade_date FROM raw"),
    "trading_calendar_range": _shown("trade_date:s", """
        SELECT DISTINCT strftime(time, '%Y%m%d') AS trade_date FROM raw
        WHERE time BETWEEN '1997-01-01' AND '1997-12-31'"""),
    "calendar_from_symbol": _shown("time:d",
        "SELECT DISTINCT time FROM raw WHERE symbol = '000001.SH'"),
    "calendar_lines": _shown("value:s", "SELECT strftime(time, '%Y-%m-%d') AS value FROM days"),
    "missing_dates": _shown("time:d", "SELECT time FROM days WHERE day(time) = 15"),
    "missing_dates_forced": _shown("time:d", "SELECT time FROM days"),
    "missing_symbol_dates": _shown("time:d symbol:s",
        "SELECT time, symbol FROM raw WHERE day(time) = 15 AND volume <= 30"),
    "keep_missing_dates": _shown(_BARS, "SELECT * FROM bars WHERE day(time) = 15"),
    "instruments": _shown("symbol:s start:d end:d".replace("end:d", '"end":d'), """
        SELECT symbol, min(time) AS start, max(time) AS "end" FROM raw GROUP BY symbol"""),
    "instrument_lines": _shown('code:s start:d "end":d', f"""
        SELECT {_code('symbol')} AS code, min(time) AS start, max(time) AS "end"
        FROM exported GROUP BY symbol"""),
    "dense_panel": _shown(
        "time:d instrument:s open:f high:f low:f close:f volume:f factor:f change:f", _GRID),
    "dense_arrays": _shown("instrument:s n_days:i n_bars:i close_sum:f volume_sum:f", f"""
        SELECT instrument, count(*) AS n_days, count(close) AS n_bars, sum(close) AS close_sum,
               sum(volume) AS volume_sum FROM ({_GRID}) GROUP BY instrument"""),
    "symbol_codes": _shown("symbol:s code:s",
        f"SELECT DISTINCT symbol, {_code('symbol')} AS code FROM raw"),
    "stocks_attached": _shown("time:d symbol:s is_st:i", """
        SELECT r.time, r.symbol, coalesce(s.is_st, 0) AS is_st FROM raw r
        LEFT JOIN (SELECT * FROM stocks WHERE exchange = 'SZ') s USING (symbol)"""),
    "bars_weekly": _shown(_OHLCV, _ROLLED + "weekly_bars"),
    "bars_monthly": _shown(_OHLCV, _ROLLED + "monthly_bars"),
    "minute_5m": _shown(_MINUTE, "SELECT *, '5m' AS freq FROM five"),
    "minute_60m": _shown(_MINUTE,
        f"SELECT *, bucket AS time, '60m' AS freq FROM ({_minute_roll(60, 'event_bars')})"),
    "minute_15m_from_5m": _shown(_MINUTE,
        f"SELECT *, bucket AS time, '15m' AS freq FROM ({_minute_roll(15, 'five')})"),
    "sma20": _shown("time:d symbol:s sma20:f", _window(f"{_sma('close', 20)} AS sma20")),
    "vol_ma5": _shown("time:d symbol:s vol_ma5:f", _window(f"{_sma('volume', 5)} AS vol_ma5")),
    "lag_diff_lead": _shown("time:d symbol:s prev_close:f change:f close_in_2:f", _window(
        f"prev_close, close - prev_close AS change, lead(close, 2) OVER ({WINDOW}) AS close_in_2")),
    "ewm12": _shown("time:d symbol:s ewm12:f",
        _window("CASE WHEN rn >= 11 THEN ema_fast END AS ewm12", "ewms")),
    "price_to_ma20": _one_factor("price_to_ma20", "sma_factors"),
    "ma_cross": _one_factor("ma_cross", "sma_factors"),
    "rsi14": _one_factor("rsi14", "features"),
    "macd_norm": _one_factor("macd_norm", "features"),
    "limit_up": _one_factor("limit_up", "sma_factors"),
    "ma20": _one_factor("ma20", "smas"),
    "ma60": _one_factor("ma60", "smas"),
    "macd": _one_factor("macd", "features"),
    "factors_long": _shown(_LONG, "SELECT * FROM factors"),
    "factors_wide": _shown("time:d symbol:s " + " ".join(f"{n}:f" for n in DEFAULT), """
        SELECT * FROM features WHERE coalesce(price_to_ma20, ma_cross, rsi14, macd_norm, limit_up)
        IS NOT NULL"""),
    "custom_factor": _shown(_LONG, f"""
        SELECT time, symbol, 'amplitude5' AS factor_name, v AS factor_value FROM (
          SELECT *, CASE WHEN rn >= 4 THEN (max(high) OVER ({WINDOW} ROWS 4 PRECEDING)
                 - min(low) OVER ({WINDOW} ROWS 4 PRECEDING)) / close END AS v FROM bars)
        WHERE v IS NOT NULL"""),
    "fwd_ret_lag1": _shown("time:d symbol:s fwd_ret:f",
        "SELECT * FROM fwd WHERE lag = 1 AND fwd_ret IS NOT NULL"),
    "fwd_ret_lag5": _shown("time:d symbol:s fwd_ret:f",
        "SELECT * FROM fwd WHERE lag = 5 AND fwd_ret IS NOT NULL"),
    "daily_ic_lag1": _shown(_DAILY, "SELECT * FROM daily WHERE lag = 1"),
    "daily_ic_long_lag5": _shown(_DAILY, "SELECT * FROM daily WHERE lag = 5"),
    "ic_summary": _shown(_SUMMARY, "SELECT * FROM summary"),
    "ic_decay": _shown("factor_name:s " + " ".join(f"lag_{n}:f" for n in LAGS),
        "SELECT factor_name, " + ", ".join(
            f"max(CASE WHEN lag = {n} THEN ic_ir END) AS lag_{n}" for n in LAGS)
        + " FROM summary GROUP BY factor_name"),
    "ic_rolling20": _shown(_DAILY + " ic_ma:f rank_ic_ma:f", f"""
        SELECT *, {_sma('ic', 20, 'PARTITION BY factor_name ORDER BY time')} AS ic_ma,
               {_sma('rank_ic', 20, 'PARTITION BY factor_name ORDER BY time')} AS rank_ic_ma
        FROM daily WHERE lag = 1 AND ic IS NOT NULL AND rank_ic IS NOT NULL"""),
    "ic_null_days": _shown("lag:i factor_name:s n_days:i", """
        SELECT lag, factor_name, count(*) AS n_days FROM daily WHERE lag = 1 AND ic IS NULL
        GROUP BY lag, factor_name"""),
    "global_ic": _shown("factor_name:s ic:f", f"""
        SELECT factor_name, {_corr('factor_value', 'fwd_ret')} AS ic FROM pairs WHERE lag = 1
        GROUP BY factor_name"""),
    "cross_section_ranks": _shown("time:d symbol:s pct_change:f rank:f", """
        SELECT time, symbol, pct_change, rank() OVER (PARTITION BY time ORDER BY pct_change)
               + (count(*) OVER (PARTITION BY time, pct_change) - 1) / 2.0 AS rank
        FROM bars WHERE pct_change IS NOT NULL"""),
    "top_3_per_day": _shown("time:d symbol:s pct_change:f", """
        SELECT time, symbol, pct_change FROM bars WHERE pct_change IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY time ORDER BY pct_change DESC, symbol) <= 3"""),
    "count_valid": _shown("symbol:s n_rows:i " + " ".join(f"n_{n}:i" for n in DEFAULT),
        "SELECT symbol, count(*) AS n_rows, " + ", ".join(f"count({n}) AS n_{n}" for n in DEFAULT)
        + " FROM features GROUP BY symbol"),
    "clean_universe": _shown(
        "time:d symbol:s prev_close:f high:f limit_up_price:f is_limit_up:i pct_change:f",
        "SELECT * FROM study"),
    "study_next_return": _shown("time:d symbol:s is_limit_up:i next_ret:f", "SELECT * FROM study_next"),
    "study_daily_ic": _shown("time:d ic:f rank_ic:f n_stocks:i", "SELECT * FROM study_daily"),
    "study_ic_stats": _shown(
        "ic_mean:f ic_std:f ic_ir:f ic_positive:f rank_ic_mean:f rank_ic_std:f rank_ic_ir:f "
        "rank_ic_positive:f n_days:i", """
        SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std,
               coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS ic_ir,
               avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS ic_positive,
               avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std,
               coalesce(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 0) AS rank_ic_ir,
               avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS rank_ic_positive,
               count(*) AS n_days FROM study_daily"""),
    "group_stats": _shown(
        "is_limit_up:i count:i mean_ret:f std_ret:f win_rate:f median_ret:f", """
        SELECT is_limit_up, count(*) AS count, avg(next_ret) AS mean_ret,
               stddev_samp(next_ret) AS std_ret,
               avg(CASE WHEN next_ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
               median(next_ret) AS median_ret FROM study_next GROUP BY is_limit_up"""),
    "symbol_median": _shown("symbol:s median:f",
        "SELECT symbol, median(pct_change) AS median FROM bars GROUP BY symbol"),
    "cond_means": _shown(
        "n_limit_up:i n_other:i limit_up_share:f mean_after_limit_up:f mean_after_other:f", """
        SELECT count(*) FILTER (WHERE is_limit_up = 1) AS n_limit_up,
               count(*) FILTER (WHERE is_limit_up = 0) AS n_other,
               avg(is_limit_up) AS limit_up_share,
               avg(next_ret) FILTER (WHERE is_limit_up = 1) AS mean_after_limit_up,
               avg(next_ret) FILTER (WHERE is_limit_up = 0) AS mean_after_other FROM study_next"""),
    "ic_hist": _shown('bin:i "left":f count:i',
        _histogram("study_daily", "ic", 30, "(SELECT min(ic) FROM study_daily)",
                   "(SELECT max(ic) FROM study_daily)")),
    "ret_hist": _shown('is_limit_up:i bin:i "left":f count:i density:f',
        _histogram("study_next", "next_ret", 60, "-10.0::DOUBLE", "10.0::DOUBLE", "is_limit_up")),
    "momentum_signals": _shown(_SIGNAL, "SELECT * FROM signals"),
    "momentum_from_long": _shown(_SIGNAL, """
        SELECT s.* REPLACE (CASE WHEN s.signal = 1 AND c.rsi14 >= 65 THEN 0 ELSE s.signal END AS signal)
        FROM signals s JOIN crossed c USING (time, symbol)"""),
    "momentum_universe": _shown(_SIGNAL, """
        SELECT * FROM signals WHERE symbol IN ('000001.SH', '000002.SZ', '000003.SH')"""),
    "signal_counts": _shown("strategy:s n_signals:i n_buy:i n_sell:i n_active:i", """
        SELECT strategy, count(*) AS n_signals, count(*) FILTER (WHERE signal = 1) AS n_buy,
               count(*) FILTER (WHERE signal = -1) AS n_sell,
               count(*) FILTER (WHERE signal <> 0) AS n_active FROM signals GROUP BY strategy"""),
    "signal_returns": _shown("time:d symbol:s strategy:s strategy_ret:f", "SELECT * FROM returns"),
    "signal_returns_joined": _shown("time:d symbol:s strategy:s strategy_ret:f", "SELECT * FROM returns"),
    "signal_returns_bucketed": _shown("time:d symbol:s strategy:s strategy_ret:f", f"""
        SELECT * FROM (
          SELECT time, symbol, strategy,
                 lag(signal) OVER ({WINDOW}) * round(pct_change, 4) / 100 AS strategy_ret
          FROM signals JOIN bars USING (time, symbol))
        WHERE strategy_ret IS NOT NULL"""),
    "equity_curve": _shown("time:d symbol:s strategy:s equity:f drawdown:f", "SELECT * FROM curves"),
    "metrics": _shown("strategy:s symbol:s " + _METRIC, _metrics("returns", "strategy, symbol")),
    "metrics_weekly": _shown("strategy:s symbol:s " + _METRIC, _metrics(
        "(SELECT strategy, symbol, date_trunc('week', time) AS week, sum(strategy_ret) AS strategy_ret "
        "FROM returns GROUP BY ALL)", "strategy, symbol", order="week", periods=52)),
    "risk_analysis": _shown(
        "strategy:s symbol:s mean:f std:f annualized_return:f information_ratio:f max_drawdown:f", f"""
        SELECT strategy, symbol, avg(strategy_ret) AS mean, stddev_samp(strategy_ret) AS std,
               avg(strategy_ret) * 238 AS annualized_return,
               avg(strategy_ret) / nullif(stddev_samp(strategy_ret), 0) * sqrt(238) AS information_ratio,
               min(total - top) AS max_drawdown
        FROM (SELECT *, max(total) OVER ({WINDOW} ROWS UNBOUNDED PRECEDING) AS top
              FROM (SELECT *, sum(strategy_ret) OVER ({WINDOW} ROWS UNBOUNDED PRECEDING) AS total
                    FROM returns))
        GROUP BY strategy, symbol"""),
    "score_panel": _shown("datetime:d instrument:s score:f", f"""
        SELECT time AS datetime, {_code('symbol')} AS instrument, coalesce(score, 0) AS score
        FROM signals"""),
    "topk_backtest": _shown("time:d n_held:i gross_ret:f cost:f strategy_ret:f", "SELECT * FROM net"),
    "topk_metrics": _shown("strategy:s " + _METRIC,
        _metrics("(SELECT *, 'top3' AS strategy FROM net)", "strategy")),
    "compare_metrics": _shown("strategy:s metric:s left_value:f right_value:f", f"""
        SELECT * FROM ({_metric_rows(_metrics("(SELECT *, 'top3' AS strategy FROM net)",
                                              "strategy", "gross_ret"), "left_value")})
        FULL JOIN ({_metric_rows(_metrics("(SELECT *, 'top3' AS strategy FROM net)",
                                          "strategy"), "right_value")}) USING (strategy, metric)"""),
    "excess_return": _shown("time:d strategy:s strategy_ret:f bench_ret:f excess_ret:f", """
        SELECT n.time, 'top3' AS strategy, strategy_ret, coalesce(b.ret, 0) AS bench_ret,
               strategy_ret - coalesce(b.ret, 0) AS excess_ret
        FROM net n LEFT JOIN (SELECT time, avg(pct_change) / 100 AS ret FROM bars
                              GROUP BY time) b USING (time)"""),
    **{f"rebalance_{unit}ly": _shown(_SIGNAL, f"""
        SELECT * FROM signals QUALIFY row_number() OVER (
          PARTITION BY symbol, date_trunc('{unit}', time) ORDER BY time DESC) = 1""")
       for unit in ("week", "month")},
    "upsert_bars": _shown(_BARS + _FLAGS, "SELECT * FROM stored_bars"),
    "upsert_factors": _shown(_LONG, """
        SELECT time, symbol, factor_name,
               factor_value + CASE WHEN day(time) % 3 = 0 THEN 1 ELSE 0 END AS factor_value
        FROM long2"""),
    "upsert_signals": _shown(_SIGNAL, """
        SELECT * REPLACE (CASE WHEN day(time) % 3 = 0 THEN 0 ELSE signal END AS signal,
                          CASE WHEN day(time) % 3 = 0 THEN '{"run":1}' ELSE '{}' END AS metadata)
        FROM signals"""),
    "sync_status": _shown(
        "data_type:s symbol:s last_sync_time:d last_date:d status:s error_msg:s updated_at:d", """
        SELECT data_type, CAST(NULL AS VARCHAR) AS symbol, DATE '2024-01-01' AS last_sync_time,
               max(time) AS last_date, status, error_msg, DATE '2024-01-01' AS updated_at
        FROM raw, (VALUES ('daily', 'ok', NULL), ('factors', 'error', 'a; b')) v(data_type, status, error_msg)
        GROUP BY data_type, status, error_msg"""),
    "incremental_factors": _shown(_LONG, "SELECT * FROM long2 WHERE time >= '2001-01-01'"),
    "incremental_factors_warmup": _shown(_LONG, f"""
        SELECT * FROM ({_unpivot(["price_to_ma20", "ma_cross", "rsi14"], "warm_factors")})
        WHERE time >= '2001-01-01'"""),
    "lake_round_trip": _shown(_BARS + _FLAGS, """
        SELECT * REPLACE (round(pct_change, 4) AS pct_change) FROM stored_bars"""),
    "catalog_tables": _shown("symbol:s n_weeks:i top_close:f", """
        SELECT symbol, count(*) AS n_weeks, max(close) AS top_close FROM weekly_bars
        GROUP BY symbol"""),
    "minute_table": _shown(_MINUTE, f"""
        SELECT *, bucket AS time, '60m' AS freq FROM ({_minute_roll(60, 'event_bars')})"""),
    "index_table": _shown("time:d symbol:s pct_change:f", """
        SELECT time, '000300.SH' AS symbol, round(avg(pct_change), 4) AS pct_change FROM bars
        GROUP BY time"""),
    "update_bars_run": _shown(_BARS, """
        SELECT * REPLACE (round(pct_change, 4) AS pct_change) FROM bars"""),
    "update_bars_partial": _shown(_BARS, """
        SELECT * REPLACE (round(pct_change, 4) AS pct_change) FROM bars
        WHERE time NOT IN (SELECT time FROM bars WHERE day(time) = 15 AND symbol LIKE '%1%')"""),
    "update_factors_run": _shown(_LONG, f"""
        SELECT * FROM ({_unpivot(["price_to_ma20", "limit_up"], "sma_factors")})"""),
    "sync_status_run": _shown(
        "data_type:s symbol:s last_sync_time:d last_date:d status:s error_msg:s updated_at:d", """
        SELECT data_type, CAST(NULL AS VARCHAR) AS symbol, DATE '2024-01-01' AS last_sync_time,
               CASE WHEN data_type = 'ic' THEN DATE '1995-01-02' ELSE max(time) END AS last_date,
               status, error_msg, DATE '2024-01-01' AS updated_at
        FROM raw, (VALUES ('daily', 'ok', NULL), ('factors', 'error', 'a; b'),
                          ('ic', 'error', 'ValueError: no factors')) v(data_type, status, error_msg)
        GROUP BY data_type, status, error_msg"""),
    "ic_store": _shown(_DAILY, """
        SELECT time, lag, factor_name, ic, rank_ic, n_stocks FROM stored_daily
        WHERE factor_name IN ('price_to_ma20', 'limit_up') AND lag IN (1, 5, 20)"""),
    "ic_run": _shown(_SUMMARY, "SELECT * FROM stored_summary"),
    "loaders": _shown("loader:s n_rows:i n_symbols:i total:f", """
        SELECT 'returns' AS loader, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols,
               sum(round(pct_change, 4)) AS total FROM bars
        UNION ALL SELECT 'panel', count(*), count(DISTINCT symbol), sum(close) FROM bars
        UNION ALL SELECT 'ohlcv', count(*), count(DISTINCT symbol), sum(close) FROM bars
        UNION ALL SELECT 'query', count(*), count(DISTINCT symbol), sum(high) FROM bars"""),
    "stocks_flagged": _shown("time:d symbol:s is_st:i exchange:s", """
        SELECT b.time, b.symbol, 0 AS is_st, CASE WHEN b.symbol LIKE '%.SZ' THEN 'SZ' ELSE 'SH' END AS exchange
        FROM raw b"""),
    "ic_report": _shown(_SUMMARY, "SELECT * FROM summary WHERE lag = 1"),
    "export_files": _shown("kind:s line:s", f"""
        SELECT 'day' AS kind, strftime(time, '%Y-%m-%d') AS line FROM days UNION ALL
        SELECT 'instrument', {_code('symbol')} || ' ' || strftime(min(time), '%Y-%m-%d') || ' '
               || strftime(max(time), '%Y-%m-%d') FROM exported GROUP BY symbol"""),
    "retention": _shown(_OHLCV, _ROLLED + "weekly_bars WHERE bucket >= '1998-01-01'"),
    "weekly_refresh": _shown(_OHLCV, f"""
        SELECT date_trunc('week', time) AS time, symbol, {_ROLL} FROM raw
        WHERE time >= date_trunc('week', DATE '1999-06-30' - INTERVAL 400 DAY)
          AND time < date_trunc('week', DATE '1999-06-28') + INTERVAL 7 DAY GROUP BY date_trunc('week', raw.time), symbol"""),
    "weekly_stream": _shown(_OHLCV, _ROLLED + "weekly_bars"),
    "weekly_closed_stream": _shown(_OHLCV, _ROLLED + """in_time_weeks
        WHERE bucket + INTERVAL 7 DAY <= (SELECT max(time) FROM in_time) - INTERVAL 7 DAY"""),
    "late_bars_stream": _shown("view:s " + _OHLCV, """
        SELECT 'weekly' AS view, * FROM raw WHERE day(time) % 10 = 7
          AND time <= (SELECT max(time) FROM raw WHERE day(time) % 10 <> 7) - INTERVAL 7 DAY"""),
    "missing_factors": _shown("factor_name:s",
        "SELECT unnest(['ma60', 'turnover']) AS factor_name FROM (SELECT count(*) FROM raw)"),
    "bar_stream": _shown(_OHLCV, "SELECT * FROM raw"),
    "monthly_stream": _shown(_OHLCV, _ROLLED + "monthly_bars"),
    "factor_stream": _shown(_LONG, _unpivot(["price_to_ma20", "ma_cross", "limit_up"], "sma_factors")),
}
