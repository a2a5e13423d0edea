"""Option, surface, bridge and calibration queries over part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import option
from larkspan.operators import bridge, calibration, surface
from larkspan.sources import table


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    spot = F.col("p_retailprice") / 10
    return p.select(
        "p_partkey", spot.alias("spot"), (spot * (0.8 + (F.col("p_size") % 9) * F.lit(0.05))).alias("strike"), ((F.col("p_partkey") % 365 + 1) / F.lit(365.0)).alias("years"),
        (F.lit(0.1) + (F.col("p_partkey") % 40) * F.lit(0.03)).alias("sigma"), (F.col("p_partkey") % 2 == 0).alias("call"),
    )


def bs_price_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = [F.col(c) for c in ("spot", "strike", "years", "sigma", "call")]
    return quotes(spark, sf_dir).select(
        "p_partkey", F.round(option.price(*args, rate=0.02), 8).alias("price"), F.round(option.delta(*args, rate=0.02), 8).alias("delta"), F.round(option.norm_cdf(F.col("spot") / 50 - 1.9), 10).alias("cdf")
    )


def bs_at_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = [F.col("spot"), F.when(F.col("p_partkey") % 3 == 0, F.col("spot")).otherwise(F.col("strike")), F.lit(0.0), F.col("sigma"), F.col("call")]
    return quotes(spark, sf_dir).select("p_partkey", F.round(option.price(*args), 8).alias("price"), option.delta(*args).alias("delta"))


def implied_vol_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir).withColumn("price", F.round(option.price(F.col("spot"), F.col("strike"), F.col("years"), F.col("sigma"), F.col("call")), 6))
    out = option.implied_vol_arrow(F.col("price"), F.col("spot"), F.col("strike"), F.col("years"), F.col("call"))
    # Only quotes with time value: at intrinsic the volatility is an artefact of the last digits.
    return q.filter(F.col("price") - option.intrinsic(F.col("spot"), F.col("strike"), F.col("call")) > 0.05).select("p_partkey", F.round(out, 4).alias("iv"))


def implied_vol_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("p_partkey") % 4 == 0, 0.0).when(F.col("p_partkey") % 4 == 1, F.col("spot") * 2).when(F.col("p_partkey") % 4 == 2, F.lit(-1.0)).otherwise(F.col("spot") * 0.5)
    years = F.when(F.col("p_partkey") % 4 == 3, 0.0).otherwise(F.col("years"))
    return quotes(spark, sf_dir).select("p_partkey", option.implied_vol(bad, F.col("spot"), F.col("strike"), years, F.lit(True)).isNull().alias("no_iv"))


def expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = F.when(F.col("p_partkey") % 11 != 0, F.lit(0.3) + (F.col("p_partkey") % 97) / F.lit(100.0))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"), F.lit(100.0).alias("spot"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("label"), F.col("p_size").alias("dte"),
        iv.alias("atm_iv"), (F.col("p_retailprice") / 50).alias("atm_straddle"),
    )


def _view(view: DataFrame) -> DataFrame:
    out = view.withColumn("caveats", F.array_join("caveats", ","))
    return out.select(*[F.round(c, 9).alias(c) if c in ("front_iv", "peak_iv", "implied_move", "probability") else F.col(c) for c in out.columns])


def surface_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = F.lit(100.0) - F.length("symbol") * 5
    return _view(surface.implied_view(expiries(spark, sf_dir), down, F.lit(140.0)))


def surface_no_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = expiries(spark, sf_dir).filter("dte < 10 OR symbol LIKE '%1'")
    return _view(surface.implied_view(near))


def two_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    spot = F.col("o_totalprice") / 1000
    found = surface.two_outcome(spot, (F.col("o_custkey") % 300).cast("double"), (F.col("o_custkey") % 500 + 40).cast("double"), (F.col("o_orderkey") % 10) / F.lit(10.0))
    return o.select("o_orderkey", found.alias("x")).select("o_orderkey", F.round("x.probability", 9).alias("probability"), F.col("x.caveat").alias("caveat"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), pos.alias("pos"), pos.cast("string").alias("name"), F.round((F.col("l_discount") - 0.05) * 3, 6).alias("delta"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("category"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(0.35).alias("base_rate"))


def bridge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bridge.adjust(events(spark, sf_dir), factors(spark, sf_dir))
    return out.select("event_id", F.round("probability", 6).alias("probability"), F.round("total_adjustment", 6).alias("total_adjustment"), F.size("capped").cast("long").alias("n_capped"))


def bridge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bridge.capped_factors(factors(spark, sf_dir))
    return out.select("event_id", "name", F.round("applied", 9).alias("applied"), "factor_capped", "category_capped")


def forecaster_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = events(spark, sf_dir), factors(spark, sf_dir)
    made = [("bounded", bridge.adjust(e, f)), ("prior", bridge.unadjusted(e)), ("uncapped", bridge.uncapped(e, f))]
    status = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("outcome"))
    log = None
    for name, df in made:
        one = df.select("event_id", F.lit(name).alias("forecaster"), F.round("probability", 6).alias("prediction"))
        log = one if log is None else log.unionByName(one)
    log = log.join(status, F.col("event_id") == F.col("o_orderkey"))
    by = ["forecaster"]
    gaps = calibration.reliability_summary(calibration.reliability(log, by=by), by)
    return calibration.brier_score(log, by).join(gaps, by).select("forecaster", F.round("brier", 6).alias("brier"), F.round("weighted_gap", 6).alias("weighted_gap"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    one = li.select(F.lit("discount").alias("log"), (F.col("l_discount") * 10).alias("prediction"), (F.col("l_returnflag") == "R").alias("outcome"))
    two = li.select(F.lit("quantity").alias("log"), (F.col("l_quantity") / 50).alias("prediction"), (F.col("l_returnflag") == "R").alias("outcome"))
    return one.unionByName(two)


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.brier_score(forecasts(spark, sf_dir), ["log"]).select("log", F.round("brier", 9).alias("brier"))


def _reliability(table_: DataFrame) -> DataFrame:
    return table_.select(*[F.round(c, 9).alias(c) if c in ("low", "high", "mean_prediction", "observed", "gap") else F.col(c) for c in table_.columns])


def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reliability(calibration.reliability(forecasts(spark, sf_dir), 10, ["log"]))


def reliability_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reliability(calibration.reliability(forecasts(spark, sf_dir), 7, ["log"]))


def reliability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.reliability_summary(calibration.reliability(forecasts(spark, sf_dir), 10, ["log"]), ["log"])
    return out.select("log", F.round("max_gap", 9).alias("max_gap"), F.round("weighted_gap", 9).alias("weighted_gap"))


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.hit_rate(forecasts(spark, sf_dir), 0.5, ["log"]).select("log", F.round("hit_rate", 9).alias("hit_rate"))


def forecast_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.operators.checks import violations

    odd = forecasts(spark, sf_dir).withColumn("prediction", F.col("prediction") * 1.1)
    return violations(odd, in_range=F.col("prediction").between(0, 1), has_outcome=F.col("outcome").isNotNull())


QUERIES = {
    f.__name__: f
    for f in (
        bs_price_delta, bs_at_expiry, implied_vol_roundtrip, implied_vol_nulls, surface_view, surface_no_targets, two_outcome, bridge_apply, bridge_audit,
        forecaster_compare, brier, reliability_curve, reliability_fine, reliability_summary, hit_rate, forecast_violations,
    )
}

_QUOTES = """q AS (SELECT p_partkey, p_retailprice / 10 AS spot, p_retailprice / 10 * (0.8::DOUBLE + (p_size % 9) * 0.05::DOUBLE) AS strike, (p_partkey % 365 + 1) / 365.0::DOUBLE AS years,
  0.1::DOUBLE + (p_partkey % 40) * 0.03::DOUBLE AS sigma, p_partkey % 2 = 0 AS call FROM part)"""
_TERMS = 100


def _cdf(x: str) -> str:
    """Normal distribution by the same kind of series, summed as a product list: term n is z * prod(2 z^2 / (2k + 1))."""
    z = f"least(abs(({x}) / sqrt(2.0::DOUBLE)), 6.0)"
    # Horner form from the last term backwards: s = 1 + r_k * s with r_k = 2 z^2 / (2k + 1).
    series = f"list_reduce(list_concat([1.0::DOUBLE], list_transform(range({_TERMS}, 0, -1), lambda k: 2 * {z} * {z} / (2 * k + 1))), lambda s, r: 1 + r * s)"
    return f"(0.5 * (1 + sign({x}) * CASE WHEN {z} >= 6 THEN 1 ELSE 2 / sqrt(pi()) * exp(-{z} * {z}) * {z} * {series} END))"


def _bs(sigma: str, rate: str = "0.0", spot: str = "spot", strike: str = "strike", years: str = "years", call: str = "call") -> str:
    """Price by d1 and d2 spelled out."""
    d1 = f"((ln({spot} / {strike}) + ({rate} + {sigma} * {sigma} / 2) * {years}) / ({sigma} * sqrt({years})))"
    sg = f"(CASE WHEN {call} THEN 1 ELSE -1 END)"
    return f"({sg} * ({spot} * {_cdf(f'{sg} * {d1}')} - {strike} * exp(-{rate} * {years}) * {_cdf(f'{sg} * ({d1} - {sigma} * sqrt({years}))')}))"


_D1 = "((ln(spot / strike) + (0.02::DOUBLE + sigma * sigma / 2) * years) / (sigma * sqrt(years)))"
_FACTORS = """f AS (SELECT l_orderkey AS event_id, l_linenumber * 10000000 + l_partkey AS pos, CAST(l_linenumber * 10000000 + l_partkey AS VARCHAR) AS name, round((l_discount - 0.05::DOUBLE) * 3, 6) AS delta, nullif(l_returnflag, 'N') AS category FROM lineitem),
f1 AS (SELECT *, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, delta)) AS one FROM f), f2 AS (SELECT *, round(sum(one) OVER (PARTITION BY event_id, category), 12) AS s FROM f1),
f3 AS (SELECT *, category IS NOT NULL AND abs(s) > 0.15::DOUBLE AS cc, CASE WHEN category IS NOT NULL AND abs(s) > 0.15::DOUBLE THEN one * 0.15::DOUBLE / abs(s) ELSE one END AS two FROM f2),
f4 AS (SELECT *, round(sum(two) OVER (PARTITION BY event_id), 12) AS raw FROM f3), f5 AS (SELECT *, greatest(-0.25::DOUBLE, least(0.25::DOUBLE, raw)) AS total FROM f4)"""
_FORECASTS = """p AS (SELECT 'discount' AS log, l_discount * 10 AS prediction, l_returnflag = 'R' AS outcome FROM lineitem UNION ALL SELECT 'quantity', l_quantity / 50, l_returnflag = 'R' FROM lineitem)"""


def _reliability_sql(n: int, source: str = "p", by: str = "log") -> str:
    return f"""b AS (SELECT {by}, CAST(least(floor(prediction / (1.0::DOUBLE / {n})), {n - 1}) AS BIGINT) AS bucket, count(*) AS n, avg(prediction) AS mean_prediction, avg(outcome::INT) AS observed FROM {source} GROUP BY ALL)"""


def _surface_sql(where: str, targets: bool) -> str:
    two = """CASE WHEN 140.0 > down AND down < 100 THEN (100 - down) / (140 - down) END AS probability,
  CASE WHEN 140 <= down THEN 'targets_inverted' WHEN NOT (down < 100) THEN 'spot_outside_targets' WHEN m > 0 AND (100 - down) / 100 < 0.5 * m THEN 'downside_inconsistent' END AS c2"""
    none = "CAST(NULL AS DOUBLE) AS probability, CAST(NULL AS VARCHAR) AS c2"
    return f"""WITH e AS (SELECT p_brand AS symbol, p_partkey AS pos, p_size AS dte, CASE WHEN p_partkey % 11 <> 0 THEN 0.3::DOUBLE + (p_partkey % 97) / 100.0::DOUBLE END AS iv, p_retailprice / 50 AS st FROM part WHERE {where}),
far AS (SELECT symbol, bool_or(dte >= 10) AS has FROM e WHERE iv IS NOT NULL GROUP BY symbol),
top AS (SELECT e.symbol, e.pos, e.iv, e.st, far.has FROM e JOIN far USING (symbol) WHERE iv IS NOT NULL AND (dte >= 10 OR NOT has) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY iv DESC, dte, pos) = 1),
front AS (SELECT symbol, iv FROM e WHERE iv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dte, pos) = 1),
v AS (SELECT s.symbol, front.iv AS front_iv, top.iv AS peak_iv, top.pos AS hump, top.st / 100 AS m, top.has, 100.0::DOUBLE - length(s.symbol) * 5 AS down
  FROM (SELECT DISTINCT symbol FROM e) s LEFT JOIN top USING (symbol) LEFT JOIN front USING (symbol)),
w AS (SELECT *, CASE WHEN NOT has THEN 'near_dated_peak' END AS c1, {two if targets else none} FROM v)
SELECT symbol, 100.0::DOUBLE AS spot, round(front_iv, 9) AS front_iv, round(peak_iv, 9) AS peak_iv, hump AS hump_expiry, round(m, 9) AS implied_move, round(probability, 9) AS probability,
  concat_ws(',', c1, c2) AS caveats, probability IS NOT NULL AND c1 IS NULL AND c2 IS NULL AS trustworthy FROM w"""


_IV_STEPS = "b0 AS (SELECT *, 1e-4::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM q1)"
for _k in range(30):
    _IV_STEPS += (
        f",\nb{_k + 1} AS MATERIALIZED (SELECT p_partkey, spot, strike, years, call, price, CASE WHEN up THEN lo ELSE (lo + hi) / 2 END AS lo, CASE WHEN up THEN (lo + hi) / 2 ELSE hi END AS hi "
        f"FROM (SELECT *, {_bs('mid')} > price AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM b{_k}) x{_k}) y{_k})"
    )

ORACLES = {
    "bs_price_delta": f"WITH {_QUOTES} SELECT p_partkey, round({_bs('sigma', '0.02::DOUBLE')}, 8) AS price, round({_cdf(_D1)} - CASE WHEN call THEN 0 ELSE 1 END, 8) AS delta, round({_cdf('(spot / 50 - 1.9::DOUBLE)')}, 10) AS cdf FROM q",
    "bs_at_expiry": f"""WITH {_QUOTES}, z AS (SELECT p_partkey, spot, CASE WHEN p_partkey % 3 = 0 THEN spot ELSE strike END AS k, call FROM q)
SELECT p_partkey, round(greatest(CASE WHEN call THEN spot - k ELSE k - spot END, 0), 8) AS price, CASE WHEN call AND spot > k THEN 1.0::DOUBLE WHEN NOT call AND spot < k THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS delta FROM z""",
    "implied_vol_roundtrip": f"WITH {_QUOTES}, q1 AS (SELECT * FROM (SELECT *, round({_bs('sigma')}, 6) AS price FROM q) x WHERE price - greatest(CASE WHEN call THEN spot - strike ELSE strike - spot END, 0) > 0.05), {_IV_STEPS} SELECT p_partkey, round((lo + hi) / 2, 4) AS iv FROM b30",
    "implied_vol_nulls": "SELECT p_partkey, true AS no_iv FROM part",
    "surface_view": _surface_sql("true", True),
    "surface_no_targets": _surface_sql("p_size < 10 OR p_brand LIKE '%1'", False),
    "two_outcome": """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS s, CAST(o_custkey % 300 AS DOUBLE) AS d, CAST(o_custkey % 500 + 40 AS DOUBLE) AS u, (o_orderkey % 10) / 10.0::DOUBLE AS m FROM orders)
SELECT o_orderkey, round(CASE WHEN u > d AND d < s AND s < u THEN (s - d) / (u - d) END, 9) AS probability,
  CASE WHEN u <= d THEN 'targets_inverted' WHEN NOT (d < s AND s < u) THEN 'spot_outside_targets' WHEN m > 0 AND (s - d) / s < 0.5 * m THEN 'downside_inconsistent' END AS caveat FROM o""",
    "bridge_apply": f"""WITH {_FACTORS}, g AS (SELECT event_id, max(total) AS total, sum(CASE WHEN one <> delta THEN 1 ELSE 0 END) + count(DISTINCT CASE WHEN cc THEN category END) + max(CASE WHEN total <> raw THEN 1 ELSE 0 END) AS n FROM f5 GROUP BY event_id)
SELECT o_orderkey AS event_id, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.35::DOUBLE + coalesce(total, 0))), 6) AS probability, round(coalesce(total, 0.0), 6) AS total_adjustment, CAST(coalesce(n, 0) AS BIGINT) AS n_capped
FROM orders LEFT JOIN g ON event_id = o_orderkey""",
    "bridge_audit": f"WITH {_FACTORS} SELECT event_id, name, round(CASE WHEN total <> raw THEN two * total / raw ELSE two END, 9) AS applied, one <> delta AS factor_capped, cc AS category_capped FROM f5",
    "forecaster_compare": f"""WITH {_FACTORS}, g AS (SELECT event_id, max(total) AS total, sum(delta) AS plain FROM f5 GROUP BY event_id),
o AS (SELECT o_orderstatus = 'F' AS outcome, coalesce(total, 0) AS total, coalesce(plain, 0) AS plain FROM orders LEFT JOIN g ON event_id = o_orderkey),
l AS (SELECT 'bounded' AS forecaster, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.35::DOUBLE + total)), 6) AS prediction, outcome FROM o UNION ALL SELECT 'prior', 0.35::DOUBLE, outcome FROM o
  UNION ALL SELECT 'uncapped', round(greatest(0.0, least(1.0, 0.35::DOUBLE + plain)), 6), outcome FROM o), {_reliability_sql(10, 'l', 'forecaster')},
w AS (SELECT forecaster, sum(abs(mean_prediction - observed) * n) / sum(n) AS wg FROM b GROUP BY forecaster)
SELECT l.forecaster, round(avg(pow(prediction - outcome::INT, 2)), 6) AS brier, round(max(wg), 6) AS weighted_gap FROM l JOIN w USING (forecaster) GROUP BY l.forecaster""",
    "brier": f"WITH {_FORECASTS} SELECT log, round(avg(pow(prediction - outcome::INT, 2)), 9) AS brier FROM p GROUP BY log",
    "reliability_summary": f"WITH {_FORECASTS}, {_reliability_sql(10)} SELECT log, round(max(abs(mean_prediction - observed)), 9) AS max_gap, round(sum(abs(mean_prediction - observed) * n) / sum(n), 9) AS weighted_gap FROM b GROUP BY log",
    "hit_rate": f"WITH {_FORECASTS} SELECT log, round(coalesce(avg(((prediction > 0.5) = outcome)::INT) FILTER (WHERE prediction <> 0.5), 0), 9) AS hit_rate FROM p GROUP BY log",
    "forecast_violations": f"""WITH {_FORECASTS} SELECT 'in_range' AS rule, count(*) FILTER (WHERE NOT (prediction * 1.1::DOUBLE BETWEEN 0 AND 1)) AS n FROM p UNION ALL SELECT 'has_outcome', count(*) FILTER (WHERE outcome IS NULL) FROM p""",
}
for _name, _n in (("reliability_curve", 10), ("reliability_fine", 7)):
    ORACLES[_name] = (
        f"WITH {_FORECASTS}, {_reliability_sql(_n)} SELECT log, bucket, round(bucket * (1.0::DOUBLE / {_n}), 9) AS low, round((bucket + 1) * (1.0::DOUBLE / {_n}), 9) AS high, n, "
        "round(mean_prediction, 9) AS mean_prediction, round(observed, 9) AS observed, round(mean_prediction - observed, 9) AS gap FROM b"
    )
