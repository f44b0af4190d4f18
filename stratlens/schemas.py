"""Canonical table layouts and the fixed vocabularies of the input files."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Trading days per year used for every annualised figure.
TRADING_DAYS = 244

# Localised CSV headers and the canonical column each one stands for.
PORTFOLIO_HEADERS = {
    "日期": "date",
    "策略": "strategy",
    "套利对数": "num_spreads",
    "日盈亏": "daily_pnl",
    "日收益率": "daily_pnl_pct",
    "手续费": "commission",
    "成交笔数": "num_trades",
    "盈利笔数": "win_trades",
    "净值": "net_value",
}
SYMBOL_HEADERS = {
    "日期": "date",
    "套利对": "spread",
    "策略": "strategy",
    "日盈亏": "daily_pnl",
    "日收益率": "daily_pnl_pct",
    "手续费": "commission",
    "成交笔数": "num_trades",
    "盈利笔数": "win_trades",
    "净值": "net_value",
}
TRADE_HEADERS = {
    "实例ID": "instance_id",
    "价差合约": "spread",
    "成交时间": "datetime",
    "交易日": "trading_day",
    "方向": "direction",
    "开平": "offset",
    "成交价": "price",
    "成交量": "volume",
    "手续费": "commission",
}

# CSV cells that mean "missing" (the default list of pandas.read_csv).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ---------------------------------------------------------------------------

# Canonical columns in order; every table but ``bars`` is led by run_id.
PORTFOLIO = {
    "run_id": "string", "date": "date", "strategy": "string", "num_spreads": "int",
    "daily_pnl": "double", "daily_pnl_pct": "double", "commission": "double",
    "num_trades": "bigint", "win_trades": "bigint", "net_value": "double", "row_id": "bigint",
}
SYMBOL = {
    "run_id": "string", "date": "date", "spread": "string", "strategy": "string",
    "daily_pnl": "double", "daily_pnl_pct": "double", "commission": "double",
    "num_trades": "bigint", "win_trades": "bigint", "net_value": "double", "row_id": "bigint",
}
TRADES = {
    "run_id": "string", "instance_id": "string", "spread": "string", "datetime": "timestamp_ntz",
    "trading_day": "date", "direction": "string", "offset": "string", "price": "double",
    "volume": "int", "commission": "double", "row_id": "bigint",
}
SIGNALS = {
    "run_id": "string", "symbol": "string", "action_datetime": "timestamp_ntz",
    "bar_datetime": "timestamp_ntz", "tradingday": "date", "offset": "string", "price": "double",
    "bar_oi": "double",
}
ROLLS = {"run_id": "string", "tradingday": "date"}
SUMMARY = {"run_id": "string", "label": "string"}
CAPITAL_CURVES = {
    "run_id": "string", "date": "date", "strategy": "string", "col_pos": "int", "capital": "double",
}
IC_SUMMARY = {"run_id": "string", "factor": "string", "ic_mean": "double"}
SYNTHESIS_SUMMARY = {"run_id": "string", "label": "string", "value": "double"}
FEATURE_IMPORTANCE = {"run_id": "string"}
BARS = {"spread": "string", "datetime": "timestamp_ntz", "close": "double", "row_id": "bigint"}


def ddl(columns: dict[str, str]) -> str:
    """Schema string for ``createDataFrame`` from a canonical column map."""
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
