"""Panel operators: backward as-of look-up and suppression of entries after losses.

Both run as one window over the tagged union of the two sides: one shuffle on the symbol,
one sort, linear work. RANGE frames let events of the same day see each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.checks import require_columns

COOLDOWN_DAYS = 31
_TAG, _VALUE, _SPAN = "_lk_side", "_lk_value", "_lk_span"


def last_before(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, into: str, span: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``left`` with ``into``: the largest ``right_on`` not after ``left_on`` among ``right`` rows of the same ``by``; null if none.

    Duplicates on the right add nothing; a null key or time matches nothing. Where one key may hold
    a large share of all rows, ``span`` (a function of time that never falls, such as the month)
    deals its rows to a task per span; what earlier spans hold is carried into each by one row a span.
    """
    require_columns(left, [*by, left_on], "left")
    require_columns(right, [*by, right_on], "right")
    others = [c for c in left.columns if c not in by and c != left_on]
    rows = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(1).alias("_"))
    a = left.select(*by, F.col(left_on).alias(_VALUE), F.lit(1).alias(_TAG), rows.alias("_lk_row"))
    b = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).cast(left.schema[left_on].dataType).alias(_VALUE), F.lit(0).alias(_TAG), F.lit(None).cast(a.schema["_lk_row"].dataType).alias("_lk_row")
    )
    parts = by if span is None else [*by, _SPAN]
    axis = a.unionByName(b)
    axis = axis if span is None else axis.withColumn(_SPAN, span(F.col(_VALUE)))
    frame = Window.partitionBy(*parts).orderBy(_VALUE).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.max(F.when(F.col(_TAG) == 0, F.col(_VALUE))).over(frame)
    keyed = F.lit(True)
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    out = axis.withColumn(into, F.when(keyed & F.col(_VALUE).isNotNull(), known)).filter(F.col(_TAG) == 1)
    if span is not None:
        held = axis.groupBy(*parts).agg(F.max(F.when(F.col(_TAG) == 0, F.col(_VALUE))).alias("_lk_most"))
        earlier = Window.partitionBy(*by).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
        carried = held.withColumn("_lk_carried", F.max("_lk_most").over(earlier)).filter("_lk_carried IS NOT NULL").select(*[F.col(c).alias(f"_lk_k{i}") for i, c in enumerate(parts)], "_lk_carried")
        same = F.lit(True)
        for i, c in enumerate(parts):
            same = same & (F.col(c) == F.col(f"_lk_k{i}"))
        out = out.join(carried, same, "left").withColumn(into, F.coalesce(into, F.when(F.col(_VALUE).isNotNull(), F.col("_lk_carried"))))
    names = {c: F.col(c) for c in by} | {left_on: F.col(_VALUE)} | {c: F.col("_lk_row")[c] for c in others}
    return out.select(*[names[c].alias(c) for c in left.columns], into)


def whole_days(later: Column, earlier: Column, timestamps: bool = False) -> Column:
    """Days between: calendar days for dates, elapsed whole days for timestamps."""
    if timestamps:
        return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000))
    return F.datediff(later, earlier)


@dataclass(frozen=True)
class CooldownResult:
    """``signals`` with its column ``blocked``, and ``suppressed``: a lazy one-row count of blocked entries."""

    signals: DataFrame
    suppressed: DataFrame


def suppress_after_losses(
    signals: DataFrame,
    losses: DataFrame,
    cooldown_days: int = COOLDOWN_DAYS,
    symbol_col: str = "symbol",
    date_col: str = "date",
    entry_col: str = "entry",
    loss_date_col: str = "loss_date",
    span: Callable[[Column], Column] | None = None,
) -> CooldownResult:
    """Block entries less than ``cooldown_days`` after the symbol's last loss, the day of the loss included; ``span`` as in ``last_before``."""
    if cooldown_days < 0:
        raise ValueError(f"cooldown_days can't be negative: {cooldown_days}")
    require_columns(signals, [symbol_col, date_col, entry_col], "signals")
    require_columns(losses, [symbol_col, loss_date_col], "losses")
    stamps = signals.schema[date_col].dataType.typeName() != "date"
    met = last_before(signals, losses.select(symbol_col, loss_date_col), [symbol_col], date_col, loss_date_col, "_lk_last", span)
    entry = F.coalesce(F.col(entry_col), F.lit(False))
    recent = F.coalesce(whole_days(F.col(date_col), F.col("_lk_last"), stamps) < cooldown_days, F.lit(False))
    gated = met.withColumn("blocked", recent & entry).withColumn(entry_col, entry & ~F.col("blocked")).drop("_lk_last")
    return CooldownResult(gated, gated.agg(F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("suppressed")))
