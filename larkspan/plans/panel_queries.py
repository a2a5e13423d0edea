"""Panel and ledger queries over lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import ledger, panel
from larkspan.sources import table

WINDOWS = (0, 1, 7, 31, 90, 400)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_linestatus") == "O").alias("entry")
    )


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount >= 0.09D")
    return lost.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("loss_date"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 120).cast("int")
    opened = F.to_date("l_shipdate")
    money = lambda x: F.round(x, 4).cast(ledger.MONEY)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("symbol"),
        opened.alias("opened"),
        F.date_add(opened, held).alias("closed"),
        money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("proceeds"),
        money(F.col("l_extendedprice") * 0.95).alias("basis"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("account"),
        F.floor(held * 5 / 7).cast("int").alias("bars_held"),
        ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 100 + F.col("l_suppkey") % 100) * 1_000 + F.unix_date(opened) % 1_000).alias("idx"),
    )


def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").filter("l_partkey % 10 = 0").groupBy(F.col("l_partkey").alias("symbol"))
    return parts.agg(F.date_add(F.max(F.to_date("l_shipdate")), 15).alias("acquired"))


_SIGNALS = """s AS (SELECT l_orderkey, l_linenumber, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_linestatus = 'O' AS entry FROM lineitem),
l AS (SELECT DISTINCT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS loss_date FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09),
j AS (SELECT s.*, l.loss_date FROM s ASOF LEFT JOIN l ON s.symbol = l.symbol AND s.date >= l.loss_date)"""


def cooldown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.suppress_after_losses(signals(spark, sf_dir), losses(spark, sf_dir)).signals


def cooldown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.suppress_after_losses(signals(spark, sf_dir), losses(spark, sf_dir)).suppressed


def cooldown_window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for days in WINDOWS:
        one = panel.suppress_after_losses(signals(spark, sf_dir), losses(spark, sf_dir), days).suppressed.withColumn("cooldown_days", F.lit(days).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def event_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    entries = events.select("event_id", F.col("user_id").alias("symbol"), F.col("ts").alias("date"), (F.col("event_type") == "purchase").alias("entry"))
    lost = events.filter("event_type = 'error'").select(F.col("user_id").alias("symbol"), F.col("ts").alias("loss_date"))
    return panel.suppress_after_losses(entries, lost, 2).signals.select("event_id", "symbol", "entry", "blocked")


def asof_last_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = panel.last_before(signals(spark, sf_dir), losses(spark, sf_dir), ["symbol"], "date", "loss_date", "last_loss")
    return met.select("l_orderkey", "l_linenumber", "symbol", "date", "last_loss", panel.whole_days(F.col("date"), F.col("last_loss")).cast("long").alias("days_since"))


def asof_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asof_last_loss`` with a task for each symbol's month, as hot symbols need it."""
    month = lambda day: F.trunc(day, "month")
    met = panel.last_before(signals(spark, sf_dir), losses(spark, sf_dir), ["symbol"], "date", "loss_date", "last_loss", month)
    return met.select("l_orderkey", "l_linenumber", "symbol", "date", "last_loss", panel.whole_days(F.col("date"), F.col("last_loss")).cast("long").alias("days_since"))


_MONEY = "CAST(round({}, 4) AS DECIMAL(18,4))"
_TRADES = f"""t AS (SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS opened,
  CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_linenumber * 13) % 120 AS INTEGER) AS closed,
  {_MONEY.format('l_extendedprice * (1 - l_discount)')} AS proceeds, {_MONEY.format('l_extendedprice * 0.95::DOUBLE')} AS basis,
  l_returnflag AS account, CAST(floor(((l_orderkey * 7 + l_linenumber * 13) % 120) * 5 / 7.0) AS INTEGER) AS bars_held,
  (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + l_suppkey % 100) * 1000 + (CAST(l_shipdate AS DATE) - DATE '1970-01-01') % 1000 AS idx FROM lineitem)"""
_HELD = """h AS (SELECT l_partkey AS symbol, '' AS acct, max(CAST(l_shipdate AS DATE)) + 15 AS acquired FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY l_partkey)"""


def _ledger_sql(account: str = "''", window: int = 30, forward: bool = False, held: bool = False, days: str = "closed - opened") -> str:
    """CTEs up to ``x``, the taxed trades: an interval join for the replacement, then the closed form of the carry."""
    acquired = f"SELECT symbol, {account} AS acct, opened AS acquired FROM t" + (" UNION ALL SELECT symbol, acct, acquired FROM h" if held else "")
    low = "t.closed" if forward else f"t.closed - {window}"
    return f"""{_TRADES}, {_HELD},
a AS (SELECT symbol, acct, acquired, count(*) AS n FROM ({acquired}) GROUP BY ALL),
r AS (SELECT t.idx, sum(a.n) - max(CASE WHEN t.opened BETWEEN {low} AND t.closed + {window} THEN 1 ELSE 0 END) >= 1 AS replaced
  FROM t JOIN a ON a.symbol = t.symbol AND a.acct = {account.replace('account', 't.account')} AND a.acquired BETWEEN {low} AND t.closed + {window} GROUP BY t.idx),
c AS (SELECT t.*, {account} AS acct, coalesce(r.replaced, false) AS replaced, proceeds - basis AS pnl, CAST({days} AS BIGINT) AS days FROM t LEFT JOIN r USING (idx)),
g AS (SELECT *, coalesce(sum(CASE WHEN replaced THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, acct ORDER BY closed, opened, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM c),
k AS (SELECT *, sum(-pnl) OVER (PARTITION BY symbol, acct, seg ORDER BY closed, opened, idx ROWS UNBOUNDED PRECEDING) AS s FROM g),
m AS (SELECT *, coalesce(lag(s) OVER w, 0) - least(0, coalesce(min(s) OVER (PARTITION BY symbol, acct, seg ORDER BY closed, opened, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS carry
  FROM k WINDOW w AS (PARTITION BY symbol, acct, seg ORDER BY closed, opened, idx)),
n AS (SELECT *, pnl - carry AS adj, pnl - carry < 0 AND replaced AS wash FROM m),
o AS (SELECT *, coalesce(sum(CASE WHEN wash THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, acct ORDER BY closed, opened, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
  lead(1) OVER (PARTITION BY symbol, acct ORDER BY closed, opened, idx) IS NULL AS last FROM n),
x AS (SELECT *, coalesce(sum(days) OVER (PARTITION BY symbol, acct, run ORDER BY closed, opened, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tacked FROM o)"""


_ROW_SQL = """SELECT idx, symbol, CAST(pnl AS DOUBLE) AS pnl, CAST(basis + carry AS DOUBLE) AS adjusted_basis,
  CAST(CASE WHEN wash THEN 0 ELSE least(adj, 0) END AS DOUBLE) AS allowed_loss, CAST(CASE WHEN wash THEN adj ELSE 0 END AS DOUBLE) AS disallowed_loss,
  CAST(CASE WHEN wash THEN 0 ELSE greatest(adj, 0) END AS DOUBLE) AS gain, wash AS is_wash_sale, days + tacked >= 365 AS long_term,
  CAST(tacked AS BIGINT) AS tacked_days, CAST(CASE WHEN last AND wash THEN -adj ELSE 0 END AS DOUBLE) AS deferred FROM x"""
_SUMMARY_SQL = """SELECT CAST(count(*) FILTER (WHERE wash) AS BIGINT) AS wash_sale_count, CAST(sum(CASE WHEN wash THEN 0 ELSE least(adj, 0) END) AS DOUBLE) AS total_allowed_loss,
  CAST(sum(CASE WHEN wash THEN 0 ELSE greatest(adj, 0) END) AS DOUBLE) AS total_gain, CAST(sum(pnl) AS DOUBLE) AS total_economic_pnl,
  CAST(sum(CASE WHEN last AND wash THEN -adj ELSE 0 END) AS DOUBLE) AS deferred_at_end FROM x"""


def _rows(taxed: DataFrame) -> DataFrame:
    amounts = ("pnl", "adjusted_basis", "allowed_loss", "disallowed_loss", "gain", "deferred")
    return taxed.select("idx", "symbol", *[F.col(c).cast("double").alias(c) for c in amounts], "is_wash_sale", "long_term", F.col("tacked_days").cast("long").alias("tacked_days"))


def wash_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_replacement(trades(spark, sf_dir)).select("idx", "symbol", "replaced")


def wash_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(ledger.apply_wash_sales(trades(spark, sf_dir)))


def wash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summarize(ledger.apply_wash_sales(trades(spark, sf_dir)))


def wash_account_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(ledger.apply_wash_sales(trades(spark, sf_dir), ledger.WashConfig(scope="symbol_and_account")))


def wash_forward_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(ledger.apply_wash_sales(trades(spark, sf_dir), ledger.WashConfig(symmetric=False)))


def wash_open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(ledger.apply_wash_sales(trades(spark, sf_dir), None, open_positions(spark, sf_dir)))


def wash_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(ledger.apply_wash_sales(trades(spark, sf_dir), ledger.WashConfig(holding="bars")))


def wash_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.invariant(ledger.apply_wash_sales(trades(spark, sf_dir)))


def trade_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger.apply_wash_sales(trades(spark, sf_dir))
    held = ledger.days_held(F.col("opened"), F.col("closed")).cast("long")
    return t.select("idx", held.alias("days_held"), ledger.taxable(F.col("gain"), F.col("allowed_loss")).cast("double").alias("taxable"))


def trade_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.operators.checks import violations

    raw = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return violations(raw, closed_before_opened=F.col("l_shipdate") >= F.col("o_orderdate"), quantity_not_positive=F.col("l_quantity") > 0)


QUERIES = {
    f.__name__: f
    for f in (
        cooldown_gate, cooldown_summary, cooldown_window_sweep, event_cooldown, asof_last_loss, asof_by_month, wash_replacement, wash_ledger, wash_summary,
        wash_account_scope, wash_forward_only, wash_open_positions, wash_bars, wash_invariant, trade_columns, trade_violations,
    )
}

_BLOCKED = "coalesce(date - loss_date < 31, false) AND entry"
ORACLES = {
    "cooldown_gate": f"WITH {_SIGNALS} SELECT l_orderkey, l_linenumber, symbol, date, entry AND NOT ({_BLOCKED}) AS entry, {_BLOCKED} AS blocked FROM j",
    "cooldown_summary": f"WITH {_SIGNALS} SELECT count(*) FILTER (WHERE {_BLOCKED}) AS suppressed FROM j",
    "cooldown_window_sweep": f"WITH {_SIGNALS} SELECT CAST(w AS BIGINT) AS cooldown_days, count(*) FILTER (WHERE entry AND date - loss_date < w) AS suppressed "
    f"FROM j CROSS JOIN (VALUES {', '.join(f'({w})' for w in WINDOWS)}) v(w) GROUP BY w",
    "event_cooldown": """WITH s AS (SELECT event_id, user_id AS symbol, ts, event_type = 'purchase' AS entry FROM events),
l AS (SELECT DISTINCT user_id AS symbol, ts AS loss_ts FROM events WHERE event_type = 'error'),
j AS (SELECT s.*, entry AND coalesce(floor((epoch_us(ts) - epoch_us(loss_ts)) / 86400000000.0) < 2, false) AS blocked FROM s ASOF LEFT JOIN l ON s.symbol = l.symbol AND s.ts >= l.loss_ts)
SELECT event_id, symbol, entry AND NOT blocked AS entry, blocked FROM j""",
    "asof_last_loss": f"WITH {_SIGNALS} SELECT l_orderkey, l_linenumber, symbol, date, loss_date AS last_loss, CAST(date - loss_date AS BIGINT) AS days_since FROM j",
    "asof_by_month": f"WITH {_SIGNALS} SELECT l_orderkey, l_linenumber, symbol, date, loss_date AS last_loss, CAST(date - loss_date AS BIGINT) AS days_since FROM j",
    "wash_replacement": f"WITH {_ledger_sql()} SELECT idx, symbol, replaced FROM x",
    "wash_ledger": f"WITH {_ledger_sql()} {_ROW_SQL}",
    "wash_summary": f"WITH {_ledger_sql()} {_SUMMARY_SQL}",
    "wash_account_scope": f"WITH {_ledger_sql(account='account')} {_ROW_SQL}",
    "wash_forward_only": f"WITH {_ledger_sql(forward=True)} {_ROW_SQL}",
    "wash_open_positions": f"WITH {_ledger_sql(held=True)} {_ROW_SQL}",
    "wash_bars": f"WITH {_ledger_sql(days='bars_held')} {_ROW_SQL}",
    "wash_invariant": f"WITH {_ledger_sql()}, y AS ({_SUMMARY_SQL}) SELECT round(abs(total_allowed_loss + total_gain - deferred_at_end - total_economic_pnl), 4) AS gap, "
    "abs(total_allowed_loss + total_gain - deferred_at_end - total_economic_pnl) <= 1e-6 AS holds FROM y",
    "trade_columns": f"WITH {_ledger_sql()} SELECT idx, CAST(closed - opened AS BIGINT) AS days_held, CAST(CASE WHEN wash THEN 0 ELSE adj END AS DOUBLE) AS taxable FROM x",
    "trade_violations": """SELECT 'closed_before_opened' AS rule, CAST(count(*) FILTER (WHERE NOT coalesce(l_shipdate >= o_orderdate, false)) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'quantity_not_positive', CAST(count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
