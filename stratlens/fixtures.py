"""Run tables derived from the TPC-H-like test data.

The SQL reads the same in Spark and in the checking database, where only the raw tables exist, so
each view is a list of common table expressions. Money is summed in whole units and turned to DOUBLE
last; returns are multiples of 1e-6, which makes every later sum exact to the digits compared.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stratlens.operators.factors import unpivot_curves

VIEWS = {
    # Money in units of 1e-4, so that sums are whole numbers.
    "fx_lines": """
        select l_returnflag as run_id, cast(l_shipdate as date) as date,
          concat(upper(substr(p_type, 1, 2)), cast(2101 + p_partkey % 12 as string), '&B', cast(2102 + p_partkey % 12 as string)) as spread,
          cast(floor(l_extendedprice * 100 + 0.5E0) as bigint) * cast(floor((l_discount - l_tax) * 100 + 0.5E0) - 5 as bigint) as pnl,
          cast(floor(l_extendedprice * 100 + 0.5E0) as bigint) * cast(floor(l_tax * 100 + 0.5E0) as bigint) as fees
        from lineitem join part on l_partkey = p_partkey""",
    "symbol_base": """
        select run_id, date, spread, cast(sum(pnl) as bigint) as pnl, cast(sum(fees) as bigint) as fees,
          cast(count(*) as bigint) as num_trades
        from fx_lines group by 1, 2, 3""",
    "fx_symbol": """
        select run_id, date, spread, pnl / 10000.0E0 as daily_pnl,
          floor(pnl / 100000.0E0 + 0.5E0) / 1000000.0E0 as daily_pnl_pct, fees / 10000.0E0 as commission, num_trades
        from symbol_base""",
    "portfolio_base": """
        select run_id, date, cast(sum(pnl) as bigint) as pnl, cast(sum(fees) as bigint) as fees,
          cast(count(*) as bigint) as num_trades, cast(count(distinct spread) as bigint) as num_spreads
        from fx_lines group by 1, 2""",
    "fx_portfolio": """
        select run_id, date, pnl / 10000.0E0 as daily_pnl, floor(pnl / 100000.0E0 + 0.5E0) / 1000000.0E0 as daily_pnl_pct,
          fees / 10000.0E0 as commission, num_trades, num_spreads
        from portfolio_base""",
    # Fills and signals fall into months of their own, with gaps; one run has signals only. Error events are
    # fills without an instance, which no close can match.
    "fx_trades": """
        select concat('R', cast(user_id % 3 as string)) as run_id,
          case when event_type <> 'error' then concat('s', cast(user_id as string)) end as instance_id,
          concat('A', cast(2101 + user_id % 12 as string), '&B', cast(2101 + user_id % 7 as string)) as spread,
          ts + interval '50' day * (user_id % 4) as datetime,
          case when event_type in ('signup', 'purchase') then 'LONG' else 'SHORT' end as direction,
          case when event_type in ('signup', 'view') then 'OPEN' else 'CLOSE' end as offset_,
          100 + value as price, cast(1 + event_id % 5 as int) as volume,
          cast(1 + event_id % 3 as double) as commission, event_id as row_id
        from events""",
    "fx_signals": """
        select concat('R', cast(user_id % 4 as string)) as run_id,
          concat('A', cast(2101 + user_id % 12 as string), '&B', cast(2101 + user_id % 7 as string)) as symbol,
          ts + interval '100' day * (user_id % 3) as action_datetime, 100 + value as price,
          case when event_type in ('signup', 'view', 'error') then 'open' else 'close' end as offset_, value * 10 as bar_oi
        from events""",
    "fx_rolls": """
        select distinct l_returnflag as run_id,
          case when extract(day from l_shipdate) = 15 and extract(month from l_shipdate) in (3, 6, 9, 12)
            then cast(l_shipdate as date) end as tradingday
        from lineitem""",
    "fx_bars": """
        select concat('A', cast(2101 + user_id % 12 as string), '&B', cast(2101 + user_id % 7 as string)) as spread,
          ts as datetime, 100 + value as close, event_id as row_id
        from events""",
    "fx_contract_bars": """
        select concat('A', cast(2101 + user_id % 12 as string)) as spread, ts as datetime, 100 + value as close, event_id as row_id
        from events""",
    # Daily profit of the spreads that have bars; every twelfth contract stays exactly flat.
    "fx_symbol_events": """
        select concat('R', cast(user_id % 3 as string)) as run_id, cast(ts as date) as date,
          concat('A', cast(2101 + user_id % 12 as string), '&B', cast(2101 + user_id % 7 as string)) as spread,
          cast(sum(case when user_id % 12 = 4 then 0 when event_type = 'purchase' then cast(value as decimal(12,2))
            when event_type = 'signup' then -cast(value as decimal(12,2)) else 0 end) as double) as daily_pnl,
          cast(0 as double) as commission
        from events group by 1, 2, 3""",
    "fx_capital": """
        select o_orderstatus as run_id, last_day(cast(o_orderdate as date)) as date,
          cast(sum(case when o_orderpriority = '1-URGENT' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as q5,
          cast(sum(case when o_orderpriority = '2-HIGH' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as q4,
          cast(sum(case when o_orderpriority = '3-MEDIUM' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as q3,
          cast(sum(case when o_orderpriority = '4-NOT SPECIFIED' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as q2,
          cast(sum(case when o_orderpriority = '5-LOW' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as q1
        from orders group by 1, 2""",
    "fx_ic": """
        select concat('R', cast(p_partkey % 3 as string)) as run_id, p_type as factor,
          round(covar_pop(cast(p_size as double), p_retailprice)
            / nullif(stddev_pop(cast(p_size as double)) * stddev_pop(p_retailprice), 0), 6) as ic_mean
        from part group by 1, 2""",
    # Half of these runs have no capital curves.
    "fx_synthesis": """
        select case when o_custkey % 2 = 0 then o_orderstatus else concat('S', o_orderstatus) end as run_id,
          o_orderpriority as label, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
        from orders group by 1, 2""",
}

RAW_TABLES = ("lineitem", "part", "orders", "events")
STRATEGIES = ("q5", "q4", "q3", "q2", "q1")


def with_views(*names: str) -> str:
    """``WITH`` clause holding the views and whatever they are built from."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)


@lru_cache
def _layout(path: str) -> StructType:
    """Columns of a parquet file, looked up once."""
    return SparkSession.active().read.parquet(path).schema


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.read.schema(_layout(path)).parquet(path)


@lru_cache
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view over the parquet files of ``sf_dir``; only its plan is kept, not its rows."""
    text = f"{with_views(name)} select * from {name}"
    used = [table for table in RAW_TABLES if re.search(rf"\b(from|join) {table}\b", text)]
    for table in used:
        text = re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text, **{table: raw(spark, sf_dir, table) for table in used})


class FixtureTables:
    """The run tables of the test data, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._sf_dir = spark, sf_dir

    def _view(self, name: str) -> DataFrame:
        return view(self._spark, self._sf_dir, name).withColumnRenamed("offset_", "offset")

    @cached_property
    def portfolio(self) -> DataFrame:
        return self._view("fx_portfolio")

    @cached_property
    def symbol(self) -> DataFrame:
        return self._view("fx_symbol")

    @cached_property
    def trades(self) -> DataFrame:
        return self._view("fx_trades")

    @cached_property
    def signals(self) -> DataFrame:
        return self._view("fx_signals")

    @cached_property
    def rolls(self) -> DataFrame:
        return self._view("fx_rolls")

    @cached_property
    def capital_curves(self) -> DataFrame:
        return unpivot_curves(self._view("fx_capital"), STRATEGIES)

    @cached_property
    def ic_summary(self) -> DataFrame:
        return self._view("fx_ic")

    @cached_property
    def synthesis_summary(self) -> DataFrame:
        return self._view("fx_synthesis")
