"""Reading an option surface: front and peak volatility, implied move, two-outcome probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_HUMP_DTE = 10
DOWNSIDE_SHARE = 0.5


def two_outcome(spot: Column, down: Column, up: Column, implied_move: Column | None = None) -> Column:
    """struct(probability, caveat): where spot lies between the outcomes; null outside, never clamped."""
    move = F.lit(None).cast("double") if implied_move is None else implied_move
    inside = (down < spot) & (spot < up)
    shallow = (move > 0) & ((spot - down) / spot < F.lit(DOWNSIDE_SHARE) * move)
    caveat = (
        F.when(up <= down, "targets_inverted")
        .when(~inside, "spot_outside_targets")
        .when(F.coalesce(shallow, F.lit(False)), "downside_inconsistent")
    )
    probability = F.when((up > down) & inside, (spot - down) / (up - down))
    return F.struct(probability.alias("probability"), caveat.alias("caveat"))


def implied_view(quotes: DataFrame, down: Column | None = None, up: Column | None = None) -> DataFrame:
    """One row per ``symbol, spot``: ``front_iv, peak_iv, hump_expiry, implied_move, probability, caveats, trustworthy``.

    ``quotes``: ``symbol, spot, pos, label, dte, atm_iv, atm_straddle``, a row per expiry in
    listed order ``pos``. Targets are expressions over symbol and spot. A spot that isn't
    positive is an error when the row is evaluated.
    """
    spot = F.when(F.col("spot") > 0, F.col("spot")).otherwise(F.raise_error(F.concat(F.lit("spot must be positive: "), F.col("spot").cast("string"))).cast("double"))
    dated = F.col("atm_iv").isNotNull()
    far = dated & (F.col("dte") >= MIN_HUMP_DTE)
    hump = F.struct("atm_iv", "label", "atm_straddle")
    order = F.struct(F.col("atm_iv").alias("iv"), (-F.col("dte")).alias("d"), (-F.col("pos")).alias("p"))
    summed = quotes.groupBy("symbol", "spot").agg(
        F.min_by(F.when(dated, F.col("atm_iv")), F.when(dated, F.struct("dte", "pos"))).alias("front_iv"),
        F.max_by(hump, F.when(far, order)).alias("far_hump"),
        F.max_by(hump, F.when(dated, order)).alias("any_hump"),
        F.max(far.cast("int")).alias("has_far"),
        F.max(dated.cast("int")).alias("has_any"),
    )
    peak = F.when(F.col("has_far") == 1, F.col("far_hump")).when(F.col("has_any") == 1, F.col("any_hump"))
    view = summed.withColumn("_hump", peak).withColumn("implied_move", F.col("_hump.atm_straddle") / spot)
    both = down is not None and up is not None
    two = two_outcome(F.col("spot"), down, up, F.col("implied_move")) if both else F.struct(F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("caveat"))
    view = view.withColumn("_two", two)
    near = F.when((F.col("has_any") == 1) & (F.col("has_far") == 0), "near_dated_peak")
    caveats = F.array_compact(F.array(near, F.col("_two.caveat")))
    return view.select(
        "symbol",
        "spot",
        "front_iv",
        F.col("_hump.atm_iv").alias("peak_iv"),
        F.col("_hump.label").alias("hump_expiry"),
        "implied_move",
        F.col("_two.probability").alias("probability"),
        caveats.alias("caveats"),
        (F.col("_two.probability").isNotNull() & (F.size(caveats) == 0)).alias("trustworthy"),
    )
