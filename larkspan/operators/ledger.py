"""Loss deferral over chains of trades, without a sequential loop.

Whether a disposal has a replacement depends on dates alone, so the loss carried along a
chain obeys carry = replaced ? max(0, carry_before - pnl) : 0, a Lindley recursion that
resets where there is no replacement. Within a segment between resets it has a closed form
in running sums and running minima, so the whole ledger is a few windows on the chain key.
Amounts are cast to DECIMAL, so sums don't depend on the order in which they are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.checks import assert_none, require_columns

MONEY = "decimal(18,4)"


@dataclass(frozen=True)
class WashConfig:
    """``scope``: "symbol" or "symbol_and_account"; ``window_days`` each way, or forward only; ``holding``: "calendar" days or trading "bars"."""

    window_days: int = 30
    symmetric: bool = True
    scope: str = "symbol"
    holding: str = "calendar"
    long_term_after: int = 365

    def __post_init__(self) -> None:
        if self.window_days < 0 or self.long_term_after < 0:
            raise ValueError("window_days and long_term_after can't be negative")
        if self.scope not in ("symbol", "symbol_and_account"):
            raise ValueError(f"unknown scope {self.scope!r}")
        if self.holding not in ("calendar", "bars"):
            raise ValueError(f"unknown holding period {self.holding!r}")


def check_trades(trades: DataFrame) -> None:
    """ValueError if a trade closes before it opens or has no positive quantity; one aggregation."""
    rules = {"closed before opened": F.col("closed") >= F.col("opened")}
    if "quantity" in trades.columns:
        rules["quantity not positive"] = F.col("quantity") > 0
    assert_none(trades, **rules)


def pnl(proceeds: Column, basis: Column) -> Column:
    """Economic profit or loss of a trade."""
    return proceeds - basis


def days_held(opened: Column, closed: Column) -> Column:
    """Calendar days from opening to closing."""
    return F.datediff(closed, opened)


def taxable(gain: Column, allowed_loss: Column) -> Column:
    """What a trade adds to taxable income."""
    return gain + allowed_loss


def _account(trades: DataFrame, config: WashConfig) -> Column:
    if config.scope == "symbol":
        return F.lit("")
    return F.coalesce(F.col("account"), F.lit("")) if "account" in trades.columns else F.lit("")


def with_replacement(trades: DataFrame, config: WashConfig | None = None, open_positions: DataFrame | None = None) -> DataFrame:
    """``trades`` with ``chain_account`` and ``replaced``: was the same thing acquired within the window of the disposal?

    One's own acquisition doesn't count; another on the same day does. Acquisitions and
    disposals share one day axis, so the interval test is a RANGE frame, not a theta join.
    """
    config = config or WashConfig()
    require_columns(trades, ["symbol", "opened", "closed"], "trades")
    rows = F.struct(*[F.col(c) for c in trades.columns])
    base = trades.select("symbol", _account(trades, config).alias("chain_account"), rows.alias("row"))
    none = F.lit(None).cast(base.schema["row"].dataType)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    sold = base.select("symbol", "chain_account", day(F.col("row.closed")).alias("day"), F.lit(0).alias("bought"), "row")
    bought = base.select("symbol", "chain_account", day(F.col("row.opened")).alias("day"), F.lit(1).alias("bought"), none.alias("row"))
    axis = sold.unionByName(bought)
    if open_positions is not None:
        require_columns(open_positions, ["symbol", "acquired"], "open positions")
        held = open_positions.select("symbol", F.lit("").alias("chain_account"), day(F.col("acquired")).alias("day"), F.lit(1).alias("bought"), none.alias("row"))
        axis = axis.unionByName(held)
    w = config.window_days
    frame = Window.partitionBy("symbol", "chain_account").orderBy("day").rangeBetween(-w if config.symmetric else 0, w)
    counted = axis.withColumn("n", F.sum("bought").over(frame)).filter("bought = 0")
    own = F.datediff(F.col("row.closed"), F.col("row.opened")) <= (w if config.symmetric else 0)
    # The key column itself, not the row's copy of it: what follows by key then needs no second shuffle.
    own_columns = [F.col(c) if c == "symbol" else F.col("row")[c].alias(c) for c in trades.columns]
    return counted.select(*own_columns, "chain_account", (F.col("n") - own.cast("int") >= 1).alias("replaced"))


def apply_wash_sales(
    trades: DataFrame, config: WashConfig | None = None, open_positions: DataFrame | None = None, order_col: str = "idx"
) -> DataFrame:
    """The tax columns of each trade, beside its own columns.

    ``trades``: ``symbol, opened, closed, proceeds, basis`` and ``order_col``, a unique
    number that breaks ties and keeps the input order; optionally ``account``, ``quantity``,
    ``bars_held``. Adds ``pnl, adjusted_basis, allowed_loss, disallowed_loss, gain,
    is_wash_sale, long_term, tacked_days, deferred`` (what the chain still carries after its
    last trade, else 0). ``disallowed_loss`` includes what the trade inherited.
    """
    config = config or WashConfig()
    require_columns(trades, ["symbol", "opened", "closed", "proceeds", "basis", order_col], "trades")
    by = ["symbol", "chain_account"]
    order = [F.col("closed"), F.col("opened"), F.col(order_col)]
    chain = Window.partitionBy(*by).orderBy(*order)
    past = chain.rowsBetween(Window.unboundedPreceding, -1)
    upto = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_days = days_held(F.col("opened"), F.col("closed"))
    if config.holding == "bars":
        own_days = F.coalesce(F.col("bars_held"), F.lit(0)) if "bars_held" in trades.columns else F.lit(0)
    t = with_replacement(trades, config, open_positions)
    t = t.withColumn("proceeds", F.col("proceeds").cast(MONEY)).withColumn("basis", F.col("basis").cast(MONEY))
    t = t.withColumn("pnl", pnl(F.col("proceeds"), F.col("basis"))).withColumn("_days", own_days.cast("long"))
    t = t.withColumn("_segment", F.coalesce(F.sum((~F.col("replaced")).cast("int")).over(past), F.lit(0)))
    inside = Window.partitionBy(*by, "_segment").orderBy(*order)
    in_past = inside.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_sum", F.sum(-F.col("pnl")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before, least = F.coalesce(F.sum(-F.col("pnl")).over(in_past), F.lit(0).cast(MONEY)), F.min("_sum").over(in_past)
    t = t.withColumn("_carry", (before - F.least(F.lit(0).cast(MONEY), F.coalesce(least, F.lit(0).cast(MONEY)))).cast(MONEY))
    t = t.withColumn("_adj", F.col("pnl") - F.col("_carry")).withColumn("is_wash_sale", (F.col("_adj") < 0) & F.col("replaced"))
    run = F.coalesce(F.sum((~F.col("is_wash_sale")).cast("int")).over(past), F.lit(0))
    t = t.withColumn("_run", run)
    in_run = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("tacked_days", F.coalesce(F.sum("_days").over(in_run), F.lit(0)))
    last = F.lead(F.lit(1)).over(chain).isNull()
    zero = F.lit(0).cast(MONEY)
    adj, wash = F.col("_adj").cast(MONEY), F.col("is_wash_sale")
    return t.select(
        *trades.columns,
        F.col("pnl").cast(MONEY).alias("pnl"),
        (F.col("basis") + F.col("_carry")).cast(MONEY).alias("adjusted_basis"),
        F.when(wash, zero).otherwise(F.least(adj, zero)).alias("allowed_loss"),
        F.when(wash, adj).otherwise(zero).alias("disallowed_loss"),
        F.when(wash, zero).otherwise(F.greatest(adj, zero)).alias("gain"),
        wash.alias("is_wash_sale"),
        (F.col("_days") + F.col("tacked_days") >= config.long_term_after).alias("long_term"),
        "tacked_days",
        F.when(last & wash, -adj).otherwise(zero).alias("deferred"),
    )


def summarize(taxed: DataFrame) -> DataFrame:
    """One row: wash_sale_count, allowed, gain, economic pnl, deferred_at_end."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return taxed.agg(
        F.coalesce(F.sum(F.col("is_wash_sale").cast("long")), F.lit(0)).alias("wash_sale_count"),
        total("allowed_loss").alias("total_allowed_loss"),
        total("gain").alias("total_gain"),
        total("pnl").alias("total_economic_pnl"),
        total("deferred").alias("deferred_at_end"),
    )


def invariant(taxed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: ``gap`` between allowed + gain - deferred and the economic total, and whether it ``holds``."""
    gap = F.abs(F.col("total_allowed_loss") + F.col("total_gain") - F.col("deferred_at_end") - F.col("total_economic_pnl"))
    return summarize(taxed).select(F.round(gap, 4).alias("gap"), (gap <= F.lit(tolerance)).alias("holds"))


def check_invariant(taxed: DataFrame, tolerance: float = 1e-6) -> None:
    """AssertionError if losses or gains went missing."""
    row = invariant(taxed, tolerance).first()
    if not row["holds"]:
        raise AssertionError(f"allowed + gain - deferred differs from the economic total by {row['gap']}")
