"""Monte Carlo, lineup, tail and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import lineup, montecarlo, report, tail
from larkspan.sources import scratch_path, table

TRIALS, BATCH = 20_000, 1_000
THRESHOLDS = (0.0, 50_000.0, 1e9)


def mc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montecarlo.batch_bounds(spark, TRIALS + 350, BATCH)


def mc_coin_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    flips = spark.range(TRIALS).select((F.col("id") % 7).alias("lane"), (montecarlo.hash_uniform(5, F.col("id")) < 0.3).cast("long").alias("heads"))
    return flips.groupBy("lane").agg(F.count(F.lit(1)).alias("trials"), F.sum("heads").alias("heads"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("mean"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("stddev"))


def mc_entity_normal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = montecarlo.EntityTable(entities(spark, sf_dir), "s_suppkey", ["mean", "stddev"])
    keyed = spark.range(TRIALS).select("id", (F.col("id") % 10).alias("key"))
    drawn = known.lookup(keyed, "key").select("key", (F.col("mean") + F.col("stddev") * montecarlo.hash_normal(9, F.col("id"))).alias("x"))
    return drawn.groupBy("key").agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_samp("x"), 8).alias("stddev"))


def mc_numpy_coin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = montecarlo.trials(spark, montecarlo.Coin(0.3), TRIALS, BATCH, 3)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("trials"), F.sum("value").alias("heads"))


def mc_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montecarlo.trials(spark, montecarlo.Indexed(), 350, 25, 1, "long")


def mc_costly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montecarlo.trials(spark, montecarlo.Costly(400), 4_000, 100, 2).groupBy("batch").agg(F.count(F.lit(1)).alias("trials"), F.avg("value").alias("mean"))


def mc_entity_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal draws of all suppliers in turn, by the order of their keys."""
    ordered = entities(spark, sf_dir).select("s_suppkey", F.col("mean").cast("double"), "stddev").orderBy("s_suppkey")
    placed = ordered.rdd.zipWithIndex().map(lambda x: (x[1], x[0]["mean"], x[0]["stddev"])).toDF("place long, mean double, stddev double")
    known = montecarlo.EntityTable(placed, "place", ["mean", "stddev"])
    drawn = montecarlo.trials(spark, montecarlo.Normal(0, 1), 100_000, 5_000, 4).withColumn("at", F.col("trial") % max(1, placed.count()))
    value = F.col("mean") + F.col("stddev") * F.col("value")
    return known.lookup(drawn, "at").groupBy("batch").agg(F.count(F.lit(1)).alias("trials"), F.avg(value).alias("mean"))


def mc_entity_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws from a cache of arrays that goes with the simulation."""
    cache = montecarlo.EntityCache.from_frame(entities(spark, sf_dir).withColumn("mean", F.col("mean").cast("double")), "s_suppkey", ["mean", "stddev"])
    drawn = montecarlo.trials(spark, montecarlo.CachedNormal(cache), 100_000, 5_000, 4)
    return drawn.groupBy("batch").agg(F.count(F.lit(1)).alias("trials"), F.avg("value").alias("mean"))


def duplicate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


SLATE = ["P", "C", "1B", "2B", "3B", "SS"]


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    place = F.element_at(F.array(*[F.lit(x) for x in SLATE]), (F.least(F.floor(k / 10), F.lit(5)) + 1).cast("int"))
    records = table(spark, sf_dir, "part").filter("p_partkey < 90").select(  # a slate of 90 is the feature's size
        k.alias("idx"), F.col("p_name").alias("name"), F.array(F.when(k < 60, place).otherwise("OF")).alias("positions"), (2500 + (size % 12) * 400).alias("salary"),
        (4 + (size % 12) * 1.2).alias("projection"), (3 + k % 4).alias("stddev"), ((k * 7) % 30 / 100).alias("ownership"), (k % 10).alias("team"),
    )
    return lineup.player_pool(records, SPEC)


SPEC = lineup.RosterSpec(
    positions=lineup.DK_MLB_CLASSIC.positions, slots=lineup.DK_MLB_CLASSIC.slots, salary_cap=45_000, salary_floor=43_500, groups=lineup.DK_MLB_CLASSIC.groups
)
ATTEMPTS = 24


def position_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("idx", "mask", "salary", F.round("projection", 6).alias("projection"), "team")


def lineup_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.eligibility(pool(spark, sf_dir), SPEC)


def lineup_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.budget_bounds(pool(spark, sf_dir), SPEC).select("slot", "picks", "m", "cheapest", "rest")


def lineup_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.objectives(pool(spark, sf_dir), ATTEMPTS, 7).select("attempt", "idx", "objective", "rank")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.greedy_relational(pool(spark, sf_dir), SPEC, ATTEMPTS, 7)


def lineup_greedy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = lineup.RosterSpec(SPEC.positions, SPEC.slots, SPEC.salary_cap, 0, SPEC.groups)
    made = lineup.greedy_relational(pool(spark, sf_dir), free, ATTEMPTS, 7)
    return made.select("attempt", F.concat_ws(",", F.transform("players", lambda x: x.cast("string"))).alias("players"), "salary")


def lineup_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("attempt", F.concat_ws(",", F.transform("players", lambda x: x.cast("string"))).alias("players"), "salary")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.build_lineups(pool(spark, sf_dir), SPEC, 60, 11)


def lineup_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)


def lineup_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.validity(_built(spark, sf_dir), pool(spark, sf_dir), SPEC)


BROKEN = 300
# The first pool number of each place's players, and how many there are.
_FIRST_OF_PLACE = [(10 if n == "C" else 50 if n == "SS" else 30 if n == "2B" else 40 if n == "3B" else 20 if n == "1B" else 60 if n == "OF" else 0, 30 if n == "OF" else 10) for n in SPEC.slot_names]


def broken_lineups(spark: SparkSession) -> DataFrame:
    """Lineups that break every rule here and there: wrong size, repeats, misfits, salaries on both sides, crowded teams."""
    i = F.col("id")
    places = [F.lit(first) + (i * (j + 3)) % n for j, (first, n) in enumerate(_FIRST_OF_PLACE)]
    places[1] = F.when(i % 7 == 1, places[0]).otherwise(places[1])
    places[2] = F.when(i % 11 == 2, F.lit(5).cast("long")).otherwise(places[2])
    crowd = F.transform(F.sequence(F.lit(0), F.lit(len(places) - 1)), lambda j: (i % 10 + 10 * (j % 9)).cast("long"))
    whole = F.when(i % 13 == 4, crowd).otherwise(F.array(*places))
    return spark.range(BROKEN).select(i.alias("lineup_id"), F.slice(whole, F.lit(1), F.when(i % 5 == 0, len(places) - 1).otherwise(len(places))).alias("players"))


def lineup_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.validity(broken_lineups(spark), pool(spark, sf_dir), SPEC)


def lineup_overlap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _hashed(spark, sf_dir).withColumnRenamed("attempt", "lineup_id")
    return lineup.overlap(made).withColumn("mean_overlap", F.round("mean_overlap", 9))


def lineup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lineup.totals(_hashed(spark, sf_dir).withColumnRenamed("attempt", "lineup_id").drop("salary"), pool(spark, sf_dir), SPEC)
    return out.select("lineup_id", "salary", F.round("projection", 6).alias("projection"), F.concat_ws(",", "names").alias("names"))


def lineup_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineup.overlap(_built(spark, sf_dir))


def lineup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = lineup.RosterSpec(("P", "C", "OF"), (lineup.Slot("C", ("C",)), lineup.Slot("OF", ("OF",), 2), lineup.Slot("P", ("P",))), 16_000, 0, (lineup.GroupCap("team", 3),))
    p = table(spark, sf_dir, "part").filter("p_partkey < 24")
    k = F.col("p_partkey")
    where = F.element_at(F.array(F.lit("P"), F.lit("C"), F.lit("OF")), (F.floor(k / 8) + 1).cast("int"))
    records = p.select(k.alias("idx"), F.array(where).alias("positions"), (3000 + k % 8 * 600).alias("salary"), (5 + F.col("p_size") % 12 * 1.5).alias("projection"), (k % 4).alias("team"))
    out = lineup.best_lineups(lineup.player_pool(records, few), few, 5)
    return out.select("lineup_id", "salary", "projection")


def tail_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("float").cast("double")
    sums = [F.round(tail.sum_positive_excess(price, t), 2).alias(f"over_{k}") for k, t in enumerate(THRESHOLDS)]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*sums)


# Measured medians of one published run, as a small inline table.
CASES = [
    ("asof/10", "asof", 0.0030026), ("asof/10", "serial", 0.0592538), ("asof/100", "asof", 0.00388792), ("asof/100", "serial", 0.0843271), ("resolve/250", "blocked", 0.00768376),
    ("resolve/250", "all_pairs", 0.195305), ("resolve/8000", "blocked", 3.96127), ("build/10", "greedy", 0.000130594), ("build/10", "exact", 151.631),
]
FILES = [("cpu-a", "2026-08-10-c1.json"), ("cpu-a", "2026-07-01-c9.json"), ("cpu-b", "2026-01-02-aa.json")]


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "`case` string, impl string, median double")


def bench_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.speedups(_cases(spark))
    return out.select("case", "impl", F.round("ratio", 6).alias("ratio"), "rank", "alone")


def bench_ratio_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.speedups(_cases(spark), "serial").select("case", "impl", F.round("ratio", 6).alias("ratio"))


def bench_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.relative_table(_cases(spark).filter("median < 1")).select("case", "impl", "relative")


def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest_results(spark.createDataFrame(FILES, "hardware_id string, file string"))


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark dump for each brand, as the runner's JSON has it: a case for each part."""
    k = F.col("p_partkey")
    stats = F.struct((k % 9 + 1).alias("rounds"), (F.col("p_retailprice") / 1000).alias("mean"), (F.col("p_size") / 100).alias("median"), (k % 4 / 8).alias("stddev"), (k % 3 / 2).alias("min"))
    told = F.struct(F.concat(F.lit("size/"), F.col("p_size")).alias("case"), F.lower("p_type").alias("impl"))
    one = F.struct(F.col("p_name").alias("name"), F.create_map(F.lit("part"), k.cast("string")).alias("params"), told.alias("extra_info"), stats.alias("stats"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(one).alias("benchmarks"))


def bench_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.convert_cases(_dumps(spark, sf_dir))
    return out.select("case", "impl", F.col("params")["part"].alias("part"), "n", F.round("mean", 9).alias("mean"), "median", "stddev", "min")


def bench_results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON and read back."""
    path = scratch_path(spark, "results")
    report.write_results(report.convert_cases(_dumps(spark, sf_dir)).drop("params").withColumn("hardware_id", F.concat(F.lit("h"), F.col("n"))), path)
    kinds = "`case` string, impl string, n bigint, mean double, median double, stddev double, min double, schema int, hardware_id string"
    back = spark.read.schema(kinds).json(path)
    return back.groupBy("hardware_id", "schema").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("case", "impl").alias("kinds"), F.round(F.sum("median"), 6).alias("median"))


def hardware_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", report.hardware_id(F.concat(F.col("p_brand"), F.lit("(R) "), F.col("p_name")), F.lit("Linux")).alias("hardware_id"))


QUERIES = {
    f.__name__: f
    for f in (
        mc_batches, mc_coin_hash, mc_entity_normal_hash, mc_numpy_coin, mc_indexed, mc_costly, mc_entity_cached, mc_entity_arrays, duplicate_entities, position_masks, lineup_eligibility, lineup_bounds,
        lineup_objectives, lineup_greedy_hash, lineup_repaired, lineup_generated, lineup_validity, lineup_broken, lineup_totals, lineup_overlap, lineup_overlap_hash, lineup_best, tail_excess, bench_cases, bench_results_file, bench_ratio,
        bench_ratio_named, bench_relative, latest_result, hardware_ids,
    )
}


def _uniform(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_POOL = """pool AS MATERIALIZED (SELECT p_partkey AS idx, p_name AS name, CASE WHEN p_partkey >= 60 THEN 'OF' ELSE ['P', 'C', '1B', '2B', '3B', 'SS'][CAST(p_partkey // 10 + 1 AS INTEGER)] END AS pos, CAST(2500 + (p_size % 12) * 400 AS BIGINT) AS salary,
  4 + (p_size % 12) * 1.2::DOUBLE AS projection, CAST(3 + p_partkey % 4 AS DOUBLE) AS stddev, ((p_partkey * 7) % 30) / 100.0::DOUBLE AS ownership, CAST(p_partkey % 10 AS VARCHAR) AS team FROM part WHERE p_partkey < 90)"""
_PLACES = [(j, s, k) for j, s in enumerate(SPEC.slots) for k in range(s.count)]
_ELIGIBLE = "SELECT idx, slot_pos, slot, picks, salary FROM pool JOIN (VALUES " + ", ".join(f"({j}, '{s.name}', '{s.eligible[0]}', {s.count})" for j, s in enumerate(SPEC.slots)) + ") s(slot_pos, slot, pos, picks) USING (pos)"
_BOUNDS = f"""el AS ({_ELIGIBLE}), rk AS (SELECT *, row_number() OVER w AS m, sum(salary) OVER (w ROWS UNBOUNDED PRECEDING) AS cheapest FROM el WINDOW w AS (PARTITION BY slot_pos ORDER BY salary, idx)),
bd AS MATERIALIZED (SELECT slot_pos, slot, picks, m, CAST(cheapest AS BIGINT) AS cheapest, CAST(coalesce((SELECT sum(z.cheapest) FROM rk z WHERE z.m = z.picks AND z.slot_pos > rk.slot_pos), 0) AS BIGINT) AS rest FROM rk WHERE m <= picks)"""
_CEIL = "(CASE WHEN a % 2 = 0 THEN 0.1::DOUBLE + " + _uniform("'7:c:' || a") + " * (0.7::DOUBLE - 0.1::DOUBLE) ELSE 0.3::DOUBLE + " + _uniform("'7:c:' || a") + " * (1.5::DOUBLE - 0.3::DOUBLE) END)"
_LEAN = "(CASE WHEN a % 2 = 0 THEN 0.6::DOUBLE + " + _uniform("'7:l:' || a") + " * (1.6::DOUBLE - 0.6::DOUBLE) ELSE 0.2::DOUBLE + " + _uniform("'7:l:' || a") + " * (1.2::DOUBLE - 0.2::DOUBLE) END)"
_OBJECTIVES = f"""ob AS MATERIALIZED (SELECT a AS attempt, pool.*, round(greatest((projection + {_CEIL} * stddev) * pow(1 - least(greatest(ownership, 0), 0.99::DOUBLE), {_LEAN})
  + (2 * {_uniform("'7:n:' || a || ':' || idx")} - 1) * greatest(abs(projection * 0.35::DOUBLE), 0.1::DOUBLE), 0.01::DOUBLE), 9) AS objective FROM range({ATTEMPTS}) r(a) CROSS JOIN pool),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY objective DESC, idx) AS rank FROM ob)"""


def _greedy() -> str:
    """The filling as a chain of one step per pick; ``hit`` counts hitters of a team, ``all_`` everyone."""
    steps = [f"s0 AS (SELECT a AS attempt, CAST([] AS BIGINT[]) AS players, CAST([] AS VARCHAR[]) AS teams, 0::BIGINT AS spent, 0::BIGINT AS last FROM range({ATTEMPTS}) r(a))"]
    for n, (j, s, k) in enumerate(_PLACES):
        left = s.count - k - 1
        least = f"(SELECT cheapest FROM bd WHERE slot_pos = {j} AND m = {left})" if left else "0"
        hitters = n if s.name != "P" else 8
        cap5 = "" if s.name == "P" else f" AND len(list_filter(s.teams[1:{hitters}], lambda t: t = c.team)) < 5"
        steps.append(
            f"s{n + 1} AS MATERIALIZED (SELECT s.attempt, list_append(s.players, c.idx) AS players, list_append(s.teams, c.team) AS teams, s.spent + c.salary AS spent, c.rank AS last FROM s{n} s JOIN ranked c ON c.attempt = s.attempt AND c.pos = '{s.eligible[0]}' "
            f"AND c.rank > {'0' if k == 0 else 's.last'} AND NOT list_contains(s.players, c.idx) AND s.spent + c.salary + {least} + (SELECT rest FROM bd WHERE slot_pos = {j} AND m = 1) <= {SPEC.salary_cap} "
            f"AND len(list_filter(s.teams, lambda t: t = c.team)) < 6{cap5} QUALIFY row_number() OVER (PARTITION BY s.attempt ORDER BY c.rank) = 1)"
        )
    return ",\n".join([_POOL, _BOUNDS, _OBJECTIVES, *steps])


_LAST = f"s{len(_PLACES)}"
_POS_OF_PLACE = "[" + ", ".join(f"'{s.eligible[0]}'" for _, s, _ in _PLACES) + "]"
_REPAIR = f"""sh AS (SELECT attempt, players, teams, spent, unnest(range(0, {len(_PLACES)})) AS place FROM {_LAST} WHERE spent < {SPEC.salary_floor}),
sw AS (SELECT sh.*, o.salary AS out_salary, c.idx AS cand, c.team AS c_team, c.salary - o.salary AS gain FROM sh JOIN pool o ON o.idx = sh.players[CAST(sh.place + 1 AS INTEGER)] JOIN pool c ON c.pos = {_POS_OF_PLACE}[CAST(sh.place + 1 AS INTEGER)]
  AND NOT list_contains(sh.players, c.idx) AND spent + c.salary - o.salary BETWEEN {SPEC.salary_floor} AND {SPEC.salary_cap}),
ok AS (SELECT * FROM sw WHERE len(list_filter(range(0, {len(_PLACES)}), lambda i: i <> place AND teams[CAST(i + 1 AS INTEGER)] = c_team)) < 6 AND (place >= 8 OR len(list_filter(range(0, 8), lambda i: i <> place AND teams[CAST(i + 1 AS INTEGER)] = c_team)) < 5)),
fx AS (SELECT attempt, list_transform(range(0, {len(_PLACES)}), lambda i: CASE WHEN i = place THEN cand ELSE players[CAST(i + 1 AS INTEGER)] END) AS players, spent + gain AS salary FROM ok QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY out_salary, place, cand) = 1),
fin AS MATERIALIZED (SELECT attempt, players, spent AS salary FROM {_LAST} WHERE spent >= {SPEC.salary_floor} UNION ALL SELECT * FROM fx)"""
_BROKEN_PLACES = [f"{first} + i * {j + 3} % {n}" for j, (first, n) in enumerate(_FIRST_OF_PLACE)]
_BROKEN_PLACES[1] = f"CASE WHEN i % 7 = 1 THEN {_BROKEN_PLACES[0]} ELSE {_BROKEN_PLACES[1]} END"
_BROKEN_PLACES[2] = f"CASE WHEN i % 11 = 2 THEN 5 ELSE {_BROKEN_PLACES[2]} END"
_BROKEN = f"""bl AS (SELECT i AS lineup_id, (CASE WHEN i % 13 = 4 THEN list_transform(range(0, {len(_PLACES)}), lambda j: i % 10 + 10 * (j % 9)) ELSE [{", ".join(_BROKEN_PLACES)}] END)[1:CASE WHEN i % 5 = 0 THEN {len(_PLACES) - 1} ELSE {len(_PLACES)} END] AS players FROM range({BROKEN}) r(i)),
be AS (SELECT lineup_id, unnest(players) AS idx, generate_subscripts(players, 1) AS place FROM bl),
bm AS (SELECT be.*, pool.pos, pool.salary, pool.team, {_POS_OF_PLACE}[place] AS wanted FROM be LEFT JOIN pool USING (idx)),
bo AS (SELECT lineup_id, count(*) AS n, count(DISTINCT idx) AS kinds, sum(salary) AS salary, bool_or(pos IS DISTINCT FROM wanted) AS misfit FROM bm GROUP BY lineup_id),
bg AS (SELECT lineup_id FROM bm GROUP BY lineup_id, team HAVING count(*) > 6 OR count(*) FILTER (WHERE wanted <> 'P') > 5)"""
_VALUES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in CASES)

ORACLES = {
    "mc_batches": f"SELECT b AS batch, b * {BATCH} AS start, least((b + 1) * {BATCH}, {TRIALS + 350}) AS stop FROM range(21) r(b)",
    "mc_coin_hash": f"SELECT id % 7 AS lane, count(*) AS trials, count(*) FILTER (WHERE {_uniform(chr(39) + '5:' + chr(39) + ' || id')} < 0.3::DOUBLE) AS heads FROM range({TRIALS}) r(id) GROUP BY 1",
    "mc_entity_normal_hash": f"""WITH d AS (SELECT s_suppkey AS key, s_acctbal / 1000 + (s_suppkey % 5 + 1) * sqrt(-2 * ln({_uniform("'9:a:' || id")})) * cos(2 * pi() * {_uniform("'9:b:' || id")}) AS x FROM range({TRIALS}) r(id) JOIN supplier ON s_suppkey = id % 10)
SELECT key, count(*) AS trials, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS stddev FROM d GROUP BY key""",
    "mc_indexed": "SELECT t // 25 AS batch, t AS trial, t AS value FROM range(350) r(t)",
    "duplicate_entities": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "position_masks": f"WITH {_POOL} SELECT idx, CAST(1 << list_position(['P', 'C', '1B', '2B', '3B', 'SS', 'OF'], pos) - 1 AS BIGINT) AS mask, salary, round(projection, 6) AS projection, team FROM pool",
    "lineup_eligibility": f"WITH {_POOL}, el AS ({_ELIGIBLE}) SELECT idx, slot_pos, slot, salary FROM el",
    "lineup_bounds": f"WITH {_POOL}, {_BOUNDS} SELECT slot, picks, m, cheapest, rest FROM bd",
    "lineup_objectives": f"WITH {_POOL}, {_OBJECTIVES} SELECT attempt, idx, objective, rank FROM ranked",
    "lineup_greedy_hash": f"WITH {_greedy()} SELECT attempt, array_to_string(players, ',') AS players, spent AS salary FROM {_LAST}",
    "lineup_repaired": f"WITH {_greedy()}, {_REPAIR} SELECT attempt, array_to_string(players, ',') AS players, salary FROM fin",
    "lineup_validity": "SELECT CAST(1 AS BIGINT) AS lineup_id, 'none' AS rule WHERE false",
    "lineup_broken": f"""WITH {_POOL}, {_BROKEN} SELECT lineup_id, 'size' AS rule FROM bo WHERE n <> {len(_PLACES)} UNION SELECT lineup_id, 'repeat' FROM bo WHERE kinds < n
UNION SELECT lineup_id, 'cap' FROM bo WHERE salary > {SPEC.salary_cap} UNION SELECT lineup_id, 'floor' FROM bo WHERE salary < {SPEC.salary_floor} UNION SELECT lineup_id, 'eligibility' FROM bo WHERE misfit UNION SELECT lineup_id, 'group' FROM bg""",
    "lineup_overlap_hash": f"""WITH {_greedy()}, {_REPAIR}, f AS (SELECT players AS p0, attempt AS a0 FROM fin ORDER BY attempt LIMIT 1)
SELECT (SELECT count(*) FROM fin) AS lineups, (SELECT count(DISTINCT p) FROM (SELECT unnest(players) AS p FROM fin)) AS players, round(avg(len(list_intersect(players, p0))), 9) AS mean_overlap FROM fin, f WHERE attempt <> a0""",
    "bench_cases": """SELECT 'size/' || p_size AS "case", lower(p_type) AS impl, CAST(p_partkey AS VARCHAR) AS part, p_partkey % 9 + 1 AS n, round(p_retailprice / 1000, 9) AS mean, p_size / 100.0::DOUBLE AS median,
  p_partkey % 4 / 8.0::DOUBLE AS stddev, p_partkey % 3 / 2.0::DOUBLE AS "min" FROM part""",
    "bench_results_file": """SELECT 'h' || (p_partkey % 9 + 1) AS hardware_id, 1 AS schema, count(*) AS cases, count(DISTINCT p_size || lower(p_type)) AS kinds, round(sum(p_size / 100.0::DOUBLE), 6) AS median FROM part GROUP BY 1""",
    "lineup_totals": f"""WITH {_greedy()}, {_REPAIR}, e AS (SELECT attempt, unnest(players) AS idx, generate_subscripts(players, 1) AS i FROM fin)
SELECT attempt AS lineup_id, CAST(sum(salary) AS BIGINT) AS salary, round(sum(projection), 6) AS projection, string_agg(name, ',' ORDER BY i) AS names FROM e JOIN pool USING (idx) GROUP BY attempt""",
    "lineup_best": """WITH p AS (SELECT p_partkey AS k, p_partkey // 8 AS g, 3000 + p_partkey % 8 * 600 AS s, 5 + p_size % 12 * 1.5::DOUBLE AS v, p_partkey % 4 AS t FROM part WHERE p_partkey < 24),
l AS (SELECT a.s + b.s + c.s + d.s AS salary, round(b.v + c.v + d.v + a.v, 6) AS projection, list_sort([a.k, b.k, c.k, d.k]) AS ks FROM p a JOIN p b ON a.g = 0 AND b.g = 1 JOIN p c ON c.g = 2 JOIN p d ON d.g = 2 AND c.k < d.k
  WHERE a.s + b.s + c.s + d.s <= 16000 AND NOT (a.t = b.t AND b.t = c.t AND c.t = d.t))
SELECT row_number() OVER (ORDER BY projection DESC, ks) - 1 AS lineup_id, CAST(salary AS BIGINT) AS salary, projection FROM l ORDER BY projection DESC, ks LIMIT 5""",
    "tail_excess": "SELECT l_returnflag, " + ", ".join(f"round(sum(CASE WHEN x > {t} THEN x - {t}::DOUBLE ELSE 0 END), 2) AS over_{k}" for k, t in enumerate(THRESHOLDS)) + " FROM (SELECT l_returnflag, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS x FROM lineitem) GROUP BY 1",
    "bench_ratio": f"SELECT \"case\", impl, round(median / min(median) OVER w, 6) AS ratio, row_number() OVER (PARTITION BY \"case\" ORDER BY median, impl) AS rank, count(*) OVER w = 1 AS alone FROM (VALUES {_VALUES}) v(\"case\", impl, median) WINDOW w AS (PARTITION BY \"case\")",
    "bench_ratio_named": f"SELECT \"case\", impl, round(median / min(CASE WHEN impl = 'serial' THEN median END) OVER (PARTITION BY \"case\"), 6) AS ratio FROM (VALUES {_VALUES}) v(\"case\", impl, median)",
    "bench_relative": f"SELECT \"case\", impl, printf('%.1fx', median / min(median) OVER (PARTITION BY \"case\")) AS relative FROM (VALUES {_VALUES}) v(\"case\", impl, median) WHERE median < 1",
    "latest_result": "SELECT hardware_id, max(file) AS file FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FILES) + ") v(hardware_id, file) GROUP BY 1",
    "hardware_ids": "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_brand || '(R) ' || p_name), '\\((r|tm)\\)', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-linux' AS hardware_id FROM part",
}
