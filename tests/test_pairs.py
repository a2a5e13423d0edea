"""Pairs scored by whole blocks: the same as the join of all pairs, and no more work than they need."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import entity
from larkspan.operators import pairs as block_pairs


def _rows(kind, n, seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["alpha", "béta", "gam", "del\U0001f600ta", "Omega"]) + str(i % 40) for i in range(120)]
    words = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    text = {
        "layout": lambda i: rng.choice(["Will Corp{}tech report revenue above $5B in Q3?", "Corp{}tech Q3 revenue over $5B?"]).format("".join(rng.choice("abc") for _ in range(3))),
        "prose": lambda i: words(rng.randrange(0, 9)),
        "long": lambda i: f"profits of {words(1)} exceed forecast " + "x" * rng.choice([3, 64, 65, 90]) + rng.choice("abc") * rng.choice([1, 2]) + " " + words(rng.randrange(0, 12)),
        "copies": lambda i: rng.choice(["Zenithcorp Q3 revenue over $5B?", "Will Zenithcorp report revenue above $5B in Q3?", "", None]),
    }[kind]
    out = []
    for i in range(n):
        day = None if rng.random() < 0.03 else dt.datetime(2026, 6, 1) + dt.timedelta(days=rng.choice([0, 0, 1, 7, 13.5, 14, 20, 27.9, 28]), microseconds=rng.randrange(2))
        value = rng.choice([None, float("nan"), 0.4, 0.45, 0.41, 0.35])
        source = None if rng.random() < 0.03 else rng.choice("xyz" if seed % 2 else "abcdefghij")
        out.append((None if i == 5 else f"r{i}", source, text(i), day, value, None if i == 9 else i - i % 3 // 2))
    return out


def _all(df):
    return sorted(tuple("" if x is None else x for x in r) for r in df.select("left", "right", "confidence", "fuzz", "jaccard", "noun_diff", "days").collect())


SCORERS = {
    "usual": entity.Scorer(),
    "timeless": entity.Scorer(max_days=None),
    "loose": entity.Scorer(min_jaccard=0.0, min_fuzz=40.0, value_bonus=-0.02),
}


@pytest.mark.parametrize("kind", ["layout", "prose", "long", "copies"])
def test_blocks_are_scored_as_pairs_are(spark, monkeypatch, kind):
    monkeypatch.setattr(entity, "CHUNK", 60)
    monkeypatch.setattr(entity, "WIDE_CHUNK", 45)
    monkeypatch.setattr(block_pairs, "TILE", 300)
    halves = lambda r: F.when(F.col("idx") % 7 == 0, None).otherwise(F.concat(F.lit("h"), F.col("idx") % 2))
    for seed, (name, scorer) in enumerate(SCORERS.items()):
        r = spark.createDataFrame(_rows(kind, 130, seed), "id string, source string, text string, ts timestamp, value double, idx long").cache()
        for blocker, cross in ((None, True), (halves, False)):
            want = _all(entity._joined_pairs(r, scorer, blocker, cross))
            assert _all(entity.scored_pairs(r, scorer, blocker, cross)) == want, (name, cross)
            assert len(want) > 10 or kind == "prose"


def test_pair_score_makes_no_join_of_pairs(spark, small):
    """sides aren't joined record by record, and no array expression runs once a pair."""
    from larkspan.plans import entity_queries as q

    plan = q.pair_score(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan and "array_intersect" not in plan


def test_matches_need_no_subsequence(spark, monkeypatch):
    """classes of texts that can't reach the threshold are left out by their bound; the links are those of all pairs."""
    import pyarrow as pa

    names = [f"Corp{x}{y}z" for x in "abcdefgh" for y in "abcdefgh"]
    n = len(names)

    def side(tag, words, idx):
        return block_pairs.Side(pa.table({"id": [tag + x for x in names], "source": [tag] * n, "value": [0.4] * n, "idx": list(range(idx, idx + n)), "at": [0] * n, "words": words, "nouns": names}))

    a = side("a", [f"5b above {x.lower()} q3 report revenue" for x in names], 0)
    b = side("b", [f"5b {x.lower()} over q3 revenue" for x in names], n)
    assert sum(1 for _ in block_pairs.Scores(a, b, entity.Scorer(), None).tiles()) == 1
    bound = block_pairs.Scores(a, b, entity.Scorer(), entity.THRESHOLD)
    assert not list(bound.tiles()) and sum(len(x[0]) for x in bound.singles()) == n

    monkeypatch.setattr(entity, "WIDE_CHUNK", 45)
    r = spark.createDataFrame(_rows("layout", 130, 1), "id string, source string, text string, ts timestamp, value double, idx long").filter("id is not null and idx is not null")
    res = entity.resolve(r)
    edges = lambda df: sorted((x["left"], x["right"]) for x in df.collect())
    want = edges(entity._joined_pairs(entity.last_of_each_id(r), entity.Scorer(), entity.iso_week_blocker(), True).filter(F.col("confidence") >= entity.THRESHOLD))
    assert edges(res.edges) == want and len(want) > 10


def test_near_pairs_are_all_pairs(spark, monkeypatch):
    """spans cut into chunks, with sides in neighbouring spans, find the pairs of comparing everything."""
    monkeypatch.setattr(entity, "CHUNK", 60)
    monkeypatch.setattr(entity, "WIDE_CHUNK", 45)
    r = spark.createDataFrame(_rows("layout", 130, 1), "id string, source string, text string, ts timestamp, value double, idx long").cache()
    for cross in (True, False):
        want = _all(entity._joined_pairs(r, entity.Scorer(), None, cross))
        assert _all(entity.near_pairs(r, cross_source=cross)) == want
        assert _all(entity.near_pairs(r, None, entity.THRESHOLD, cross)) == [x for x in want if x[2] >= entity.THRESHOLD]


def test_missed_pairs_make_no_join_of_records(spark, small):
    """neither the truth nor what was found joins records with records, and both keep to pairs from the threshold on."""
    from larkspan.plans import entity_queries as q

    plan = q.missed_pairs(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "array_intersect" not in plan
    r = q.records(spark, small)
    found = {(x["left"], x["right"]) for x in q._found(r).collect()}
    truth = {(x["left"], x["right"]) for x in q.matched_within(r).collect()}
    assert {tuple(x) for x in q.missed_pairs(spark, small).collect()} == truth - found and len(found) > 100


def test_missed_pairs_are_scored_once(spark, small):
    """what blocks keep apart is scored in one pass over records read once; nothing found is made, written or joined for it."""
    from larkspan.plans import entity_queries as q

    plan = q.missed_pairs(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "SortMergeJoin" not in plan and "prepared" not in plan and "Union" not in plan


def test_pairs_apart_are_the_truth_without_the_found(spark, monkeypatch):
    """pairs of different blocks, or without one, are those that comparing blocks misses; so with chunks and without spans."""
    monkeypatch.setattr(entity, "WIDE_CHUNK", 45)
    halves = lambda r: F.when(F.col("idx") % 7 == 0, None).otherwise(F.concat(F.lit("h"), F.col("idx") % 2))
    pairs = lambda df: sorted((x["left"], x["right"]) for x in df.collect())
    for kind in ("layout", "copies"):
        r = spark.createDataFrame(_rows(kind, 130, 1), "id string, source string, text string, ts timestamp, value double, idx long").filter("id is not null").cache()
        for blocker, scorer, cross in ((entity.iso_week_blocker(), entity.Scorer(), True), (halves, entity.Scorer(), False), (halves, entity.Scorer(max_days=None), True)):
            found = entity.scored_pairs(r, scorer, blocker, cross, entity.THRESHOLD)
            truth = entity._joined_pairs(r, scorer, None, cross).filter(F.col("confidence") >= entity.THRESHOLD)
            want = pairs(entity.missed_pairs(found, truth))
            assert pairs(entity.missed_by_blocks(r, blocker, scorer, cross_source=cross)) == want and len(want) > 10


def test_a_side_is_made_once(monkeypatch):
    """sources and spans of a group are brought to texts once each, however many others they meet; lengths are compared in arrays."""
    import numpy as np
    import pyarrow as pa

    made, real = [], block_pairs.Side
    monkeypatch.setattr(block_pairs, "Side", lambda t: (made.append(len(t)), real(t))[1])
    n = 80
    zero, own = [0] * n, list(range(n))
    cols = {"id": [f"r{i}" for i in own], "source": ["xy"[i % 2] for i in own], "value": [0.4] * n, "idx": own, "at": zero, "words": [f"5b a\x1cb{i // 4} q3" for i in own], "nouns": ["Corp" * (i % 3 > 0) for i in own]}
    t = pa.table(cols | {"part": [i // 2 % 2 for i in own], "c": zero, "ci": zero, "cj": zero})
    met = [(a, b) for a, b, _, _ in block_pairs._sides(t, True)]
    assert made == [20] * 4 and len(met) == 3
    assert sorted(map(tuple, met[0][0].words)) == sorted({("5b", f"a\x1cb{i // 4}", "q3") for i in own if i % 4 == 0 or i % 4 == 1})
    lengths = np.array([(c, c + (c > 0), x, y, k) for c in (0, 5) for x in (0, 3, 7) for y in (0, 4) for k in range(min(x, y) + 1)])
    assert block_pairs.fuzz_of_each(*lengths.T).tolist() == [float(block_pairs.fuzz_of(*map(int, r))) for r in lengths]


def test_overrides_meet_bounded_links(spark, small):
    """F2: forced and blocked pairs apply to the links of the bounded score as to those of all pairs, which aren't made."""
    from larkspan.plans import entity_queries as q

    r = q.records(spark, small).filter("idx < 200")
    pair = lambda *x: spark.createDataFrame(x, "left string, right string")
    forced, blocked = pair(("b7", "zz"), ("a5", "b5")), pair(("b3", "a3"), ("a5", "b5"))
    res = entity.resolve(r, forced=forced, blocked=blocked)
    assert "array_intersect" not in res.edges._jdf.queryExecution().executedPlan().toString()
    matched = entity._joined_pairs(r, entity.Scorer(), entity.iso_week_blocker(), True).filter(F.col("confidence") >= entity.THRESHOLD)
    want = {(x["left"], x["right"]) for x in entity.apply_overrides(matched, forced, blocked).collect()}
    assert {(x["left"], x["right"]) for x in res.edges.collect()} == want
    assert ("a3", "b3") not in want and {("b7", "zz"), ("a5", "b5")} <= want


@pytest.mark.parametrize("kind", ["layout", "copies"])
def test_labels_are_counted_without_pairs(spark, small, monkeypatch, kind):
    """counts of labels without a row a pair are the counts of the rows."""
    from larkspan.plans import entity_queries as q

    plan = q.pair_labels(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan and "confidence" not in plan
    monkeypatch.setattr(entity, "WIDE_CHUNK", 45)
    monkeypatch.setattr(block_pairs, "TILE", 300)
    for seed in (0, 1):
        r = spark.createDataFrame(_rows(kind, 130, seed), "id string, source string, text string, ts timestamp, value double, idx long").cache()
        for blocker, cross, threshold in ((None, True, 0.65), (entity.iso_week_blocker(), True, 0.65), (entity.iso_week_blocker(), False, 0.99)):
            rows = entity.label_pairs(entity._joined_pairs(r, entity.Scorer(), blocker, cross), threshold).groupBy("label").count()
            got = entity.label_counts(r, None, blocker, threshold, cross_source=cross)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_settled_components_leave_the_rounds(spark, monkeypatch):
    """components that are stars already take no further rounds, a small remainder takes none; the components stay the same."""
    from larkspan.operators import graph

    rng = random.Random(4)
    path = list(range(1000, 1060))
    rng.shuffle(path)
    edges = [(i * 100_000, i * 100_000 + 7 + j) for i in range(1, 40) for j in range(20)] + list(zip(path, path[1:]))
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    sets = {}
    for x, y in edges:
        whole = sets.setdefault(x, {x}) | sets.setdefault(y, {y})
        sets |= dict.fromkeys(whole, whole)
    want = {x: min(s) for x, s in sets.items() if len(s) > 1}
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (written.append((name, out := write(df, name))), out)[1])
    for kind in ("long", "string"):
        for most in (0, graph.LOCAL_EDGES):
            monkeypatch.setattr(graph, "LOCAL_EDGES", most)
            written.clear()
            df = spark.createDataFrame(edges, "left long, right long").selectExpr(f"cast(left as {kind}) left", f"cast(right as {kind}) right")
            got = {int(r["node"]): int(r["component"]) for r in graph.connected_components(df).collect()}
            assert got == want
            stars = [out.count() for name, out in written if name == "stars"]
            assert stars[-1] < stars[0] / 5 if most == 0 else not stars


def test_records_are_prepared_once(spark, small):
    """the links, their counts and the blocks' sizes read prepared records; no text is normalised for them again."""
    from larkspan.plans import entity_queries as q

    plan = q.entity.resolve(q.records(spark, small)).edges._jdf.queryExecution().executedPlan().toString()
    assert "prepared" in plan and "Window" not in plan and "c_custkey" not in plan


def test_rounded_as_spark_rounds(spark):
    """numbers are rounded where pairs are made, to the doubles that ``round`` makes of them, ties and their neighbours too."""
    import numpy as np

    rng = np.random.default_rng(7)
    ties = (rng.integers(0, 100_000_000, 4000) + 0.5) / 1e6
    x = np.concatenate([[0.0, 1.0, 100.0, 5e-7, 0.0003125, 27 / 86_400, 0.1953125], ties, np.nextafter(ties, 0), np.nextafter(ties, 200), rng.random(4000), 100 * rng.random(4000), rng.integers(0, 14 * 86_400, 4000) / 86_400, rng.integers(1, 300, 4000) / rng.integers(300, 4096, 4000)])
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x.tolist()], "x double").select(F.round("x", 6)).collect()]
    assert block_pairs.rounded(x, 6).tolist() == want and not np.isnan(x).any()


def test_pair_score_costs_spark_a_copy_a_pair(spark, small):
    """nothing is projected after pairs are made, and no value but ids is looked at for null; the rows are those of the join, rounded."""
    from larkspan.plans import entity_queries as q

    df = q.pair_score(spark, small)
    after = df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "round(" not in after and "Project" not in after
    assert [f.name for f in df.schema if f.nullable] == ["left", "right"] and dict(df.dtypes)["noun_diff"] == "bigint"
    want = entity._joined_pairs(entity.last_of_each_id(q.records(spark, small)), entity.Scorer(), entity.iso_week_blocker(), True)
    want = want.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes])
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100


def test_pairs_are_sent_in_batches(monkeypatch):
    """no batch holds more pairs than stated, and together they hold all."""
    import pyarrow as pa

    n = 40
    zero, own = [0] * n, list(range(n))
    cols = {"id": [f"r{i}" for i in own], "source": ["xy"[i % 2] for i in own], "value": [0.4] * n, "idx": own, "at": zero, "words": [f"5b corp{i // 4} q3" for i in own], "nouns": ["Corp"] * n}
    t = pa.table(cols | {"part": zero, "c": zero, "ci": zero, "cj": zero})
    run = lambda: list(block_pairs.scored(entity.Scorer(), True, None, 6)(iter(t.to_batches())))
    whole = pa.Table.from_batches(run())
    monkeypatch.setattr(block_pairs, "BATCH", 3)
    parts = run()
    assert len(whole) == 400 and max(map(len, parts)) == 3 and pa.Table.from_batches(parts).equals(whole)
