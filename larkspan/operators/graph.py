"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.sources import materialize


#: So many edges at most are settled in one task: rounds would take longer to plan than to run.
LOCAL_EDGES = 1_000_000


def _settled(edges: DataFrame) -> DataFrame:
    """The stars ``hi, lo`` of a small graph's components, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        kinds: list[pa.DataType] = []

        def root(x):  # noqa: ANN001, ANN202
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            kinds = batch.schema.types
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        stars = [(x, top) for x in above if (top := root(x)) != x]
        for at in range(0, len(stars), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*stars[at : at + 100_000]), kinds)], names=["hi", "lo"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` reaches.

    Each round links every node's larger neighbours to its smallest (large star), then every
    node's neighbours below it to the smallest (small star), until nothing changes; that takes
    a logarithmic number of rounds. After the first one, components that are stars already
    leave: later rounds only have the others, and the last ``LOCAL_EDGES`` are one task's. Rounds only use aggregations with map-side partials
    and joins on nodes, and are written to the shared folder, so lineage stays short.
    """
    state = (
        edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .filter("hi IS NOT NULL AND lo IS NOT NULL AND hi <> lo")
        .distinct()
    )
    state = materialize(state, "edges")
    done: list[DataFrame] = []
    both_ways = lambda edges: edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    ordered = state.schema["hi"].dataType.typeName() in ("string", "integer", "long")  # in Python as in Spark
    for turn in range(max_rounds):
        if ordered and state.count() <= LOCAL_EDGES:
            done.append(materialize(_settled(state), "settled"))
            break
        ups, downs = F.count(F.when(F.col("b") < F.col("a"), 1)), F.count(F.when(F.col("b") > F.col("a"), 1))
        least = both_ways(state).groupBy("a").agg(F.min("b").alias("m"), ups.alias("ups"), downs.alias("downs"))
        # Written first: a node with a third of all edges is then a skewed join that can be split, not one task's rows.
        least = materialize(least.select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "ups", "downs"), "least")
        between = least.filter("ups > 1 OR ups > 0 AND downs > 0")  # neither the least node of a star nor a leaf of one
        if between.isEmpty():
            done.append(state)
            break
        if turn:
            # Every star of a component that isn't settled has a node between stars.
            stars = state.join(between.select("k"), F.col("hi") == F.col("k"), "left_semi").select("lo")
            unsettled = materialize(stars.unionByName(between.filter("downs > 0").select(F.col("k").alias("lo"))).distinct().withColumnRenamed("lo", "u"), "unsettled")
            state = materialize(state.join(unsettled, F.col("lo") == F.col("u"), "left").select("hi", "lo", F.col("u").isNotNull().alias("unsettled")), "marked")
            done.append(state.filter("NOT unsettled").select("hi", "lo"))
            state = state.filter("unsettled").select("hi", "lo")
            if ordered and state.count() <= LOCAL_EDGES:
                continue
        both = both_ways(state)
        least = least.select("k", "m")
        large = (
            both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        )
        large = large.filter("hi <> lo").distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), "m")
        small = large.join(floor, F.col("hi") == F.col("k"))
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(small.select("hi", F.col("m").alias("lo")))
        state = materialize(small.filter("hi <> lo").distinct(), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    state = reduce(DataFrame.unionByName, done)
    found = state.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = state.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return found.unionByName(roots.distinct())
