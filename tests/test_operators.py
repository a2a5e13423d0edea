"""Facts and small brute-force versions for the operators."""

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspan.functions import option
from larkspan.functions import text as tx
from larkspan.operators import bridge, calibration, entity, graph, ledger, lineup, montecarlo, panel, report, surface, tail

DAY = dt.date(2024, 1, 1)


def d(n):
    return DAY + dt.timedelta(days=n)


def one(df):
    return df.first()[0]


# panel


def gate(spark, signals, losses, **kw):
    s = spark.createDataFrame(signals, "symbol string, date date, entry boolean, extra int")
    x = spark.createDataFrame(losses, "symbol string, loss_date date")
    return panel.suppress_after_losses(s, x, **kw)


def test_cooldown_edges(spark):
    rows = [("A", d(31), True, 1), ("A", d(30), True, 2), ("A", d(0), True, 3), ("A", d(5), None, 4), ("A", d(5), False, 5), ("B", d(1), True, 6), ("A", d(-1), True, 7)]
    out = gate(spark, rows, [("A", d(0)), ("A", d(0))])
    blocked = {r["extra"]: (r["entry"], r["blocked"]) for r in out.signals.collect()}
    assert blocked == {1: (True, False), 2: (False, True), 3: (False, True), 4: (False, False), 5: (False, False), 6: (True, False), 7: (True, False)}
    assert one(out.suppressed) == 2
    assert one(gate(spark, rows, [("A", d(0))], cooldown_days=0).suppressed) == 0
    assert out.signals.columns == ["symbol", "date", "entry", "extra", "blocked"]


def test_cooldown_refusals(spark):
    with pytest.raises(ValueError, match="negative"):
        gate(spark, [("A", d(0), True, 1)], [("A", d(0))], cooldown_days=-1)
    with pytest.raises(ValueError, match="signals has no column"):
        panel.suppress_after_losses(spark.range(1), spark.range(1))


@pytest.mark.parametrize("cooldown", [1, 7, 31, 400])
def test_cooldown_against_loop(spark, cooldown):
    rng = random.Random(cooldown)
    rows = [(f"S{i % 5}", d(rng.randrange(200)), rng.random() < 0.5, i) for i in range(150)]
    losses = [(f"S{rng.randrange(6)}", d(rng.randrange(200))) for _ in range(20)]
    got = {r["extra"]: r["blocked"] for r in gate(spark, rows, losses, cooldown_days=cooldown).signals.collect()}
    for s, day, entry, i in rows:
        past = [x for t, x in losses if t == s and x <= day]
        assert got[i] == bool(entry and past and (day - max(past)).days < cooldown)


# ledger


def taxed(spark, trades, config=None, held=None):
    rows = [(s, o, c, float(p), float(b), 1.0, acc, bars, i) for i, (s, o, c, p, b, acc, bars) in enumerate(trades)]
    t = spark.createDataFrame(rows, "symbol string, opened date, closed date, proceeds double, basis double, quantity double, account string, bars_held int, idx int")
    h = spark.createDataFrame(held, "symbol string, acquired date") if held else None
    return ledger.apply_wash_sales(t, config, h)


def loop(trades, config, held=()):
    out, chains = {}, {}
    for i, t in enumerate(trades):
        chains.setdefault((t[0], (t[5] or "") if config.scope == "symbol_and_account" else ""), []).append(i)
    for (symbol, account), ids in chains.items():
        bought = [trades[i][1] for i in ids] + [a for s, a in held if s == symbol and account == ""]
        carry, days = 0.0, 0
        for i in sorted(ids, key=lambda i: (trades[i][2], trades[i][1], i)):
            _, opened, closed, proceeds, basis, _, bars = trades[i]
            pnl = proceeds - basis - carry
            low = closed - dt.timedelta(days=config.window_days if config.symmetric else 0)
            near = [a for a in bought if low <= a <= closed + dt.timedelta(days=config.window_days)]
            if opened in near:
                near.remove(opened)
            held_days = (bars if config.holding == "bars" else (closed - opened).days) + days
            wash = pnl < -1e-9 and bool(near)
            out[i] = (round(basis + carry, 4), wash, days, held_days >= config.long_term_after)
            carry, days = (-pnl, held_days) if wash else (0.0, 0)
    return out


@pytest.mark.parametrize("config", [ledger.WashConfig(), ledger.WashConfig(symmetric=False), ledger.WashConfig(scope="symbol_and_account"), ledger.WashConfig(window_days=0), ledger.WashConfig(holding="bars")])
def test_ledger_against_loop(spark, config):
    rng = random.Random(3)
    trades = []
    for _ in range(120):
        o = rng.randrange(150)
        trades.append((f"S{rng.randrange(4)}", d(o), d(o + rng.randrange(60)), rng.randrange(80, 120), 100, rng.choice(["x", None, ""]), rng.randrange(200)))
    held = [("S1", d(100)), ("S9", d(5))]
    got = {r["idx"]: (float(r["adjusted_basis"]), r["is_wash_sale"], r["tacked_days"], r["long_term"]) for r in taxed(spark, trades, config, held).collect()}
    assert got == loop(trades, config, held)


def test_ledger_chain(spark):
    chain = [("A", d(0), d(10), 900, 1000, None, 0), ("A", d(15), d(25), 850, 1000, None, 0), ("A", d(30), d(90), 1600, 1000, None, 0)]
    out = taxed(spark, chain).orderBy("idx").collect()
    assert [r["is_wash_sale"] for r in out] == [True, True, False]
    assert [float(r["adjusted_basis"]) for r in out] == [1000, 1100, 1250]
    assert float(out[2]["gain"]) == 350
    ledger.check_invariant(taxed(spark, chain))
    broken = taxed(spark, chain).withColumn("gain", F.col("gain") + 1)
    with pytest.raises(AssertionError):
        ledger.check_invariant(broken)


def test_ledger_refusals(spark):
    with pytest.raises(ValueError):
        ledger.WashConfig(window_days=-1)
    bad = spark.createDataFrame([(d(5), d(1), 0.0)], "opened date, closed date, quantity double")
    with pytest.raises(ValueError, match="closed before opened"):
        ledger.check_trades(bad)


# text and entities


def scalar(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_text_facts(spark):
    r = scalar(
        spark, n=tx.normalize(F.lit("Will Acme, Inc. ship?")), z=tx.normalize(F.lit(None).cast("string")), t=tx.tokenize(F.lit("Acme a bc of X")),
        p=tx.proper_nouns(F.lit("Buy IBM Now")), q=tx.proper_nouns(F.lit("Will Iowa vote like New Hampshire?")),
        j=tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")),
    )
    assert (r["n"], r["z"], r["t"], r["p"], r["q"], r["j"]) == ("acme inc ship", "", ["acme", "bc"], [], ["Hampshire", "Iowa"], 0.0)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row2 = [0]
        for i, y in enumerate(b):
            row2.append(row[i] + 1 if x == y else max(row[i + 1], row2[-1]))
        row = row2
    return row[-1]


def test_lcs_forms_agree(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    pairs = [(word(rng.randrange(12)), word(rng.randrange(15))) for _ in range(60)] + [(word(70), word(80)), ("", ""), ("a" * 60, "a" * 61)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", tx.lcs_length(F.col("a"), F.col("b")).alias("x"), tx.lcs_arrow(F.col("a"), F.col("b")).alias("y")).collect():
        assert r["x"] == r["y"] == lcs(r["a"], r["b"])


def test_token_set_ratio(spark):
    r = scalar(spark, a=tx.token_set_ratio(F.lit("acme ships"), F.lit("ships acme today")), b=tx.token_set_ratio(F.lit(""), F.lit("x")), c=tx.token_set_ratio(F.lit("ab"), F.lit("ba")))
    assert (r["a"], r["b"], r["c"]) == (100.0, 0.0, 50.0)


def _records(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, text string, ts timestamp, value double, idx long")


def test_resolution(spark):
    t = lambda n: dt.datetime(2026, 6, 1) + dt.timedelta(days=n)
    rows = [
        ("a1", "x", "Will Zenithcorp report revenue above $5B in Q3?", t(0), 0.4, 0),
        ("b1", "y", "Zenithcorp Q3 revenue over $5B?", t(0), 0.41, 1),
        ("c1", "y", "Unrelated weather in Paris", t(0), None, 2),
        ("d1", "y", "Zenithcorp Q3 revenue over $5B?", None, 0.41, 3),
        ("e1", "x", "", t(0), None, 4),
    ]
    r = _records(spark, rows)
    res = entity.resolve(r)
    assert {x["id"] for x in res.assignments.collect()} == {"a1", "b1"}
    pair = lambda a, b: spark.createDataFrame([(a, b)], "left string, right string")
    assert entity.resolve(r, blocked=pair("b1", "a1")).assignments.count() == 0
    forced = entity.resolve(r, blocked=pair("a1", "b1"), forced=pair("a1", "b1")).assignments
    assert forced.count() == 2
    assert {x["id"] for x in entity.resolve(r, forced=pair("a1", "zz")).assignments.collect()} == {"a1", "b1", "zz"}
    with pytest.raises(ValueError):
        entity.Scorer(max_days=0)


def test_stable_ids_and_dedup(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "left string, right string")
    ids = {r["id"]: r["cluster_id"] for r in entity.clusters(e).collect()}
    assert ids["a"] == ids["b"] == ids["c"] != ids["x"]
    df = spark.createDataFrame([("k", 1, "old"), ("k", 5, "new"), ("m", 2, "only")], "id string, idx int, v string")
    assert {tuple(r) for r in entity.last_of_each_id(df).collect()} == {("k", 1, "new"), ("m", 2, "only")}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(15)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {r[0]: r[1] for r in graph.connected_components(spark.createDataFrame(edges, "left long, right long")).collect()} == want
    assert graph.connected_components(spark.createDataFrame([], "left long, right long")).count() == 0


# options


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(-7, 7), min_size=5, max_size=20))
def test_norm_cdf(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", option.norm_cdf(F.col("x")).alias("y")).collect():
        assert abs(r["y"] - 0.5 * (1 + math.erf(r["x"] / math.sqrt(2)))) < 1e-12


def test_option_facts(spark):
    f = lambda *x: [F.lit(v) for v in x]
    r = scalar(
        spark, **{f"iv{k}": option.implied_vol(option.price(*f(100.0, 105.0, 0.5, s, True)), *f(100.0, 105.0, 0.5, True)) for k, s in enumerate((0.2, 0.5, 1.5))},
        atm=option.delta(*f(100.0, 100.0, 0.0, 0.2, True)), bad=option.price(*f(-1.0, 100.0, 1.0, 0.2, True)), none=option.implied_vol(*f(500.0, 100.0, 100.0, 1.0, True)),
        parity=option.price(*f(100.0, 90.0, 1.0, 0.3, True)) - option.price(*f(100.0, 90.0, 1.0, 0.3, False)),
    )
    assert all(abs(r[f"iv{k}"] - s) < 1e-5 for k, s in enumerate((0.2, 0.5, 1.5)))
    assert (r["atm"], r["bad"], r["none"]) == (0.0, None, None) and abs(r["parity"] - 10) < 1e-9
    with pytest.raises(Exception, match="positive"):
        scalar(spark, x=option.price(F.lit(0.0) + F.rand() * 0, *f(100.0, 1.0, 0.2, True), strict=True))


def test_implied_vol_forms_agree(spark):
    rows = [(5.0, 100.0, 105.0, 0.5, True), (0.0, 100.0, 100.0, 1.0, True), (3.0, 100.0, 90.0, 1.0, True), (30.0, 100.0, 90.0, 1.0, False), (500.0, 100.0, 90.0, 1.0, True), (None, 1.0, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "p double, s double, k double, t double, c boolean")
    args = [F.col(x) for x in "psktc"]
    for r in df.select(option.implied_vol(*args).alias("x"), option.implied_vol_arrow(*args).alias("y")).collect():
        assert (r["x"] is None) == (r["y"] is None) and (r["x"] is None or abs(r["x"] - r["y"]) < 1e-8)


def test_surface(spark):
    q = "symbol string, spot double, pos int, label string, dte int, atm_iv double, atm_straddle double"
    rows = [("A", 100.0, 0, "w", 5, 0.9, 3.0), ("A", 100.0, 1, "m", 30, 0.6, 8.0), ("A", 100.0, 2, "q", 60, 0.6, 9.0), ("B", 50.0, 0, "w", 3, 0.5, None), ("C", 10.0, 0, "x", 20, None, 1.0)]
    out = {r["symbol"]: r for r in surface.implied_view(spark.createDataFrame(rows, q), F.lit(80.0), F.lit(130.0)).collect()}
    assert (out["A"]["front_iv"], out["A"]["hump_expiry"], out["A"]["implied_move"], out["A"]["probability"], out["A"]["trustworthy"]) == (0.9, "m", 0.08, 0.4, True)
    assert out["B"]["caveats"] == ["near_dated_peak", "spot_outside_targets"] and out["B"]["probability"] is None
    assert out["C"]["front_iv"] is None and out["C"]["hump_expiry"] is None


# bridge and calibration


def test_bridge(spark):
    e = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9)], "event_id int, base_rate double")
    rows = [(1, 0, "a", 0.08, "k"), (1, 1, "b", 0.04, "k"), (1, 2, "c", 0.5, None), (3, 0, "x", 0.1, None), (3, 1, "y", 0.1, None), (3, 2, "z", 0.1, None)]
    f = spark.createDataFrame(rows, "event_id int, pos int, name string, delta double, category string")
    out = {r["event_id"]: r for r in bridge.adjust(e, f, bridge.Caps(per_category=0.06)).collect()}
    assert [round(x["delta"], 9) for x in out[1]["applied"]] == [0.04, 0.02, 0.1]
    assert out[1]["capped"] == ["c", "k"] and round(out[1]["probability"], 9) == 0.66
    assert out[2]["probability"] == 0.5 and out[2]["capped"] == []
    assert out[3]["capped"] == ["total"] and out[3]["probability"] == 0.99


def test_calibration(spark):
    f = lambda rows: spark.createDataFrame(rows, "prediction double, outcome boolean")
    assert calibration.reliability(f([(1.0, True)])).first()["bucket"] == 9
    assert one(calibration.hit_rate(f([(0.5, True)]))) == 0.0
    assert abs(one(calibration.hit_rate(f([(0.9, True), (0.2, False), (0.7, False), (0.5, True)]))) - 2 / 3) < 1e-12
    assert abs(one(calibration.brier_score(f([(0.8, True), (0.4, False)]))) - 0.1) < 1e-12
    for bad in ([], [(1.2, True)], [(None, True)]):
        with pytest.raises(ValueError):
            calibration.check_forecasts(f(bad))


# Monte Carlo


def test_monte_carlo(spark):
    assert montecarlo.run(spark, montecarlo.Indexed(), 350, batch_size=25).value == list(range(350))
    for size in (1, 7, 100):
        here = montecarlo.run(spark, montecarlo.Normal(2, 3), 60, batch_size=size, run_seed=9)
        there = montecarlo.run(None, montecarlo.Normal(2, 3), 60, batch_size=size, run_seed=9, backend="local")
        assert here.value == there.value and here.n_batches == -(-60 // size)
    a = montecarlo.run(None, montecarlo.Draw(), 20, batch_size=5, backend="local").value
    assert a != montecarlo.run(None, montecarlo.Draw(), 20, batch_size=4, backend="local").value
    seen = []
    mean = montecarlo.run(spark, montecarlo.Coin(0.5), 400, montecarlo.MeanReducer(), 100, on_progress=lambda x, n: seen.append((x, n)))
    assert 0.3 < mean.value < 0.7 and seen == [(100, 400), (200, 400), (300, 400), (400, 400)] and mean.n_trials == 400
    for bad in ({"n_trials": -1}, {"n_trials": 1, "batch_size": 0}, {"n_trials": 1, "backend": "x"}):
        with pytest.raises(ValueError):
            montecarlo.run(spark, montecarlo.Draw(), **bad)


def test_both_backends_fold_alike(spark):
    """Means come from equal parts in equal order, so they are equal to the last bit; the serial loop agrees in distribution."""
    kinds = dict(n_trials=5_050, reducer=montecarlo.MeanReducer(), batch_size=100, run_seed=6)
    here, there = montecarlo.run(spark, montecarlo.Normal(2, 3), **kinds), montecarlo.run(None, montecarlo.Normal(2, 3), backend="local", **kinds)
    assert here.value == there.value and here.n_batches == 51
    loop = montecarlo.serial_loop(montecarlo.Normal(2, 3), 5_050, 6)
    assert abs(sum(loop) / len(loop) - here.value) < 0.3
    assert montecarlo.run(spark, montecarlo.Draw(), 0).value == [] and montecarlo.run(spark, montecarlo.Draw(), 0, montecarlo.MeanReducer()).value is None


def test_monte_carlo_queries_against_local_runs(spark, small):
    from larkspan.plans import simulation_queries as q

    for run, sim, n, size, seed, column in ((q.mc_numpy_coin, montecarlo.Coin(0.3), q.TRIALS, q.BATCH, 3, "heads"), (q.mc_costly, montecarlo.Costly(400), 4_000, 100, 2, "mean")):
        for r in run(spark, small).collect():
            want = montecarlo.run_batch(sim, seed, r["batch"], r["batch"] * size, min(n, (r["batch"] + 1) * size))
            assert r["trials"] == len(want) and abs(r[column] - sum(want) / (1 if column == "heads" else len(want))) < 1e-9


def test_entity_cache(spark):
    rows = [{"k": "a", "m": 1, "s": 2.0}, {"k": "b", "m": 3, "s": 0.5}]
    cache = montecarlo.EntityCache.from_records(rows, "k", ["m", "s"])
    assert len(cache) == 2 and cache.keys == ["a", "b"] and cache.fields == ["m", "s"] and cache.index_of("b") == 1
    assert cache.field("m").dtype == float and cache.field_list("s") == [2.0, 0.5]
    for wrong, error, said in (
        (lambda: cache.index_of("z"), KeyError, "'z'"),
        (lambda: cache.field("x"), KeyError, "'x'"),
        (lambda: montecarlo.EntityCache.from_records([*rows, {"k": "c", "m": 1}], "k", ["m", "s"]), KeyError, "record 2 has no 's'"),
        (lambda: montecarlo.EntityCache.from_records([*rows, {"m": 1, "s": 1}], "k", ["m"]), KeyError, "record 2 has no 'k'"),
        (lambda: montecarlo.EntityCache.from_records(rows + rows[:1], "k", ["m"]), ValueError, "'a' is not unique"),
        (lambda: montecarlo.EntityCache(["a", "b"], {"m": [1.0]}), ValueError, "'m' has 1 values"),
    ):
        with pytest.raises(error, match=said):
            wrong()
    frame = spark.createDataFrame([(x["k"], float(x["m"]), x["s"]) for x in reversed(rows)], "k string, mean double, stddev double")
    known = montecarlo.EntityCache.from_frame(frame, "k", ["mean", "stddev"])
    assert known.keys == ["a", "b"]
    with pytest.raises(ValueError, match="more than 1"):
        montecarlo.EntityCache.from_frame(frame, "k", ["mean"], max_rows=1)
    slow = montecarlo.FrameNormal(frame.orderBy("k").toPandas(), "k")
    values = [montecarlo.run(spark, sim, 40, batch_size=8, run_seed=3).value for sim in (montecarlo.CachedNormal(known), montecarlo.LookupNormal(known), slow)]
    assert values[0] == values[1] == values[2]


def test_entity_table(spark):
    e = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, m double")
    t = montecarlo.EntityTable(e, "k", ["m"])
    assert {tuple(r) for r in t.lookup(spark.createDataFrame([("a",), ("z",)], "key string"), "key").collect()} == {("a", 1.0), ("z", None)}
    with pytest.raises(ValueError, match="not unique"):
        montecarlo.EntityTable(e.unionByName(e), "k", ["m"])


# lineups


def test_lineups(spark, small):
    from larkspan.plans.simulation_queries import SPEC, pool

    p = pool(spark, small)
    out = lineup.build_lineups(p, SPEC, 20, 1)
    rows = out.collect()
    assert len({frozenset(r["players"]) for r in rows}) == len(rows) == 20
    assert lineup.validity(out, p, SPEC).count() == 0
    again = lineup.build_lineups(p.repartition(3), SPEC, 20, 1).collect()
    assert [r["players"] for r in rows] == [r["players"] for r in again]
    bad = spark.createDataFrame([(0, [1, 1, 2])], "lineup_id long, players array<long>")
    assert {r["rule"] for r in lineup.validity(bad, p, SPEC).collect()} >= {"size", "repeat", "floor"}
    for wrong in (lambda: lineup.Slot("X", ()), lambda: lineup.RosterSpec(("A",), (lineup.Slot("X", ("B",)),), 10), lambda: lineup.JitterProfile((2.0, 1.0))):
        with pytest.raises(ValueError):
            wrong()


# tail and reports


def test_tail(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,), (2.0,)], "x double")
    assert one(df.agg(tail.sum_positive_excess(F.col("x"), 2.0))) == 1.0


def test_report(spark, tmp_path):
    raw = tmp_path / "r.json"
    raw.write_text('{"benchmarks": [{"name": "t", "params": {"n": 5}, "extra_info": {"case": "c", "impl": "i"}, "stats": {"rounds": 3, "mean": 1.0, "median": 2.0, "stddev": 0.1, "min": 0.5}}]}')
    cases = report.convert_cases(report.read_raw(spark, str(raw)))
    assert tuple(cases.select("case", "impl", "n", "median").first()) == ("c", "i", 3, 2.0)
    report.write_results(cases.withColumn("hardware_id", F.lit("h")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_streaming_gate(spark, tmp_path):
    from larkspan.streaming import streaming_cooldown

    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("A", t(0), None, True), ("A", t(3), True, False), ("A", t(40), True, False), ("B", t(1), True, False)]
    schema = "symbol string, ts timestamp, entry boolean, loss boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streaming_cooldown(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["symbol"], r["ts"], r["blocked"]) for r in spark.sql("SELECT * FROM gated").collect()} == {("A", t(3), True), ("A", t(40), False), ("B", t(1), False)}


def test_all_entities_are_drawn(spark):
    from larkspan.plans import simulation_queries as q

    sf = "/root/testdata/sf0.1"
    rows = q.entities(spark, sf).orderBy("s_suppkey").collect()
    assert len(rows) > 500
    sim = montecarlo.EntityNormal(tuple(float(r["mean"]) for r in rows), tuple(r["stddev"] for r in rows))
    got = {r["batch"]: (r["trials"], r["mean"]) for r in q.mc_entity_cached(spark, sf).collect()}
    for b in range(20):
        want = montecarlo.run_batch(sim, 4, b, b * 5_000, (b + 1) * 5_000)
        assert got[b][0] == 5_000 and abs(got[b][1] - sum(want) / 5_000) < 1e-9
    for r in q.mc_entity_arrays(spark, sf).collect():
        assert r["trials"] == 5_000 and abs(r["mean"] - got[r["batch"]][1]) < 1e-9


def test_recall_truth_over_all_customers(spark, small):
    """The join by spans finds the pairs that comparing everything finds."""
    from larkspan.plans import entity_queries as q

    def pairs(df):
        return sorted((r["left"], r["right"], round(r["confidence"], 9)) for r in df.collect())

    r = q.records(spark, "/root/testdata/sf0.01").filter("idx < 600")
    want = pairs(entity.label_pairs(entity.scored_pairs(r, None, None)).filter("label = 'matched'"))
    assert pairs(q.matched_within(r)) == want and len(want) > 150


def test_subsequences_of_all_lengths():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé\U0001f600 ") for _ in range(n))
    pairs = [(word(n), word(m)) for n in (0, 1, 5, 62, 63, 64, 70) for m in (0, 1, 9, 62, 63, 64, 90)]
    import pyarrow as pa

    a, b = pa.array(["x", *[p[0] for p in pairs], None])[1:], pa.array([p[1] for p in pairs] + ["q"])
    assert tx.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in pairs] + [0]
    assert tx.lcs_lengths(a[:0], b[:0]).tolist() == []


def test_one_python_call_a_pair(spark, small):
    from larkspan.plans import entity_queries as q

    plan = q.pair_labels(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [lambda") + plan.count("ArrowEvalPython [<lambda>") <= 1 and plan.count("ArrowEvalPython") <= 2


def test_exact_lineups(spark, small):
    """Branch and bound against enumeration, on pools where salary, floor and caps bind; then a slate of 90."""
    spec = lineup.RosterSpec(
        ("P", "C", "OF"), (lineup.Slot("C", ("C",)), lineup.Slot("OF", ("OF",), 2), lineup.Slot("FLEX", ("OF", "C")), lineup.Slot("P", ("P",))), 21_000, 20_000, (lineup.GroupCap("team", 2),)
    )
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, [("P", "C", "OF")[i % 3]] + (["C"] if i % 7 == 0 else []), rng.randrange(25, 60) * 100, rng.randrange(20, 90) / 7, f"t{rng.randrange(4)}") for i in range(24)]
        pool = lineup.player_pool(spark.createDataFrame(rows, "idx long, positions array<string>, salary long, projection double, team string"), spec)
        want = [(r["salary"], r["projection"]) for r in lineup.best_lineups(pool, spec, 6).collect()]
        got = lineup.exact_lineups(pool, spec, 6)
        assert [r["projection"] for r in got.collect()] == [p for _, p in want] and len(want) == 6
        assert lineup.validity(got, pool, spec).count() == 0
    rng = random.Random(8)
    places = ["P", "C", "1B", "2B", "3B", "SS"]
    rows = [(i, [places[i // 10] if i < 60 else "OF"], 2500 + rng.randrange(90) * 50, 4 + rng.random() * 14, f"t{i % 10}") for i in range(90)]
    mlb = lineup.RosterSpec(lineup.DK_MLB_CLASSIC.positions, lineup.DK_MLB_CLASSIC.slots, 40_000, 38_000, lineup.DK_MLB_CLASSIC.groups)
    slate = lineup.player_pool(spark.createDataFrame(rows, "idx long, positions array<string>, salary long, projection double, team string"), mlb)
    best = lineup.best_lineups(slate, mlb, 2)
    greedy = lineup.totals(lineup.build_lineups(slate, mlb, 60, 11), slate, mlb).agg(F.max("projection")).first()[0]
    assert lineup.validity(best, slate, mlb).count() == 0 and best.collect()[0]["projection"] >= greedy - 1e-6


def test_serial_lineups_are_alike(spark):
    from larkspan.plans import simulation_queries as q

    slate = q.pool(spark, "/root/testdata/sf0.01")
    frame = slate.toPandas()
    serial = lineup.serial_lineups(frame, q.SPEC, 60, 5)
    worth = dict(zip(frame["idx"], frame["projection"]))
    mean = lambda many: sum(worth[p] for x in many for p in x) / len(many)
    for turns in ("run", "chunk"):
        spread = [r["players"] for r in lineup.build_lineups(slate, q.SPEC, 60, 11, turns=turns).collect()]
        assert len(spread) == len(serial) == 60 and abs(mean(serial) - mean(spread)) < 0.1 * mean(serial)
    assert len({frozenset(x) for x in serial}) == 60
    with pytest.raises(ValueError, match="empty"):
        lineup.serial_lineups(frame[:0], q.SPEC, 1)
    assert lineup.serial_lineups(frame[:5], q.SPEC, 1) == []


def test_times_are_utc_in_any_session_zone(spark):
    """Blocks and scores don't depend on the session's zone; times without a zone count as UTC."""
    rows = [("a1", "x", "Will Acmecorp ship by June?", "2026-03-08 02:30:00.25", 1.0, 1), ("b1", "y", "Acmecorp ship June", "2026-03-08 23:30:00", 1.0, 2), ("b2", "y", "Acmecorp ship June", "2026-03-09 00:30:00", 1.0, 3)]
    plain = spark.createDataFrame(rows, "id string, source string, text string, at string, value double, idx long")
    found = {}
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for kind, ts in (("naive", F.to_timestamp_ntz("at")), ("zoned", F.to_timestamp_ltz(F.concat("at", F.lit("Z"))))):
                r = plain.withColumn("ts", ts).drop("at")
                blocks = [(x["id"], x["b"]) for x in r.select("id", entity.iso_week_blocker()(r).alias("b")).orderBy("id").collect()]
                pairs = [(x["left"], x["right"], round(x["days"], 9)) for x in entity.scored_pairs(r, None, None).orderBy("left", "right").collect()]
                found[zone, kind] = (blocks, pairs)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len({str(x) for x in found.values()}) == 1
    blocks, pairs = found["UTC", "naive"]
    assert blocks == [("a1", "2026W10"), ("b1", "2026W10"), ("b2", "2026W11")]
    assert pairs == [("a1", "b1", round((20 * 3600 + 3599.75 + 0 - 0) / 86400, 9)), ("a1", "b2", round((21 * 3600 + 3599.75) / 86400, 9))]


def test_plain_functions_score_pairs(spark):
    """A scorer may be a function of two records: a confidence, or a struct with one; null rejects."""
    rows = [("a", "x", "t", None, 1.0, 1), ("b", "y", "t", None, 1.0, 2), ("c", "y", "t", None, 3.0, 3)]
    records = spark.createDataFrame(rows, "id string, source string, text string, ts timestamp, value double, idx long")
    close = lambda a, b: F.when(F.abs(a["value"] - b["value"]) < 5, 1 - F.abs(a["value"] - b["value"]) / 5)
    plain = entity.resolve(records, close, threshold=0.9)
    assert {(r["left"], r["right"], r["label"]) for r in plain.pairs.collect()} == {("a", "b", "matched"), ("a", "c", "none")}
    assert [(r["id"], r["size"]) for r in plain.assignments.orderBy("id").collect()] == [("a", 2), ("b", 2)]
    whole = entity.scored_pairs(records, lambda a, b: F.when(a["value"] == b["value"], F.struct(F.lit(0.7).alias("confidence"), a["text"].alias("why"))))
    assert [tuple(r) for r in whole.collect()] == [("a", "b", 0.7, "t")] and whole.columns == ["left", "right", "confidence", "why"]


def test_environment(spark):
    assert report.environment(spark)["spark"] == spark.version


def test_writes_leave_no_shuffle_files(spark):
    """op3_minhash: a step's shuffle files go with its end, so disk holds one step's at a time."""
    import glob
    import time

    from larkspan.sources import materialize

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in dirs for p in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    out = materialize(spark.range(50_000).groupBy((F.col("id") % 99).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 99
