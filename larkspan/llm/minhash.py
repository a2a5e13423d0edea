"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct word shingles as 64-bit hashes. One pass over the sorted
set gives the signature: the hash range is cut into ``rows * bands`` bins, each bin keeps
its smallest hash, and an empty bin borrows from bins drawn by a fixed hash sequence until
one is occupied (optimal densification). Each run of ``rows`` bins is a band; documents
with an equal band share a bucket. All sets go this way, short ones too: their bins borrow
most values, each drawn anew, so bands stay independent given the set. With 64 bands of 6
two sets at a similarity of 0.75 miss each other with a probability of about 4e-6.

Candidates stay linear in a bucket's size:

1. documents with identical sets form a class, only its smallest id goes on; band keys that
   one class has alone are dropped before any ids move;
2. each bucket is a star: its hub is the member found in most buckets, which is the least
   altered one among altered copies, and every member is verified against the hub, so there
   are never more pairs than memberships;
3. confirmed links give components. Pairs that share a bucket but neither a hub nor a
   component remain. They are found exactly, and by less than all pairs of a bucket: over the
   documents of buckets with several components, shingles are ordered from rare to frequent;
   two sets similar enough share one of their first ``n - ceil(t * n) + 1`` shingles, and its
   place bounds what they can share beyond it. Only pairs that pass both meet in the join,
   one side of it holding only documents outside their buckets' largest components. So a
   passage or line that many documents share makes buckets, but no pairs, and no link
   between documents of one bucket is lost.

Every link is confirmed on the full sets: 100 * intersection >= 100 * t * union, exactly,
in integers. Hub texts are repeated once for every ``star_rows`` members, so a hub with a
third of all rows is spread over tasks.

Defined results: null, empty and blank texts have an empty set (``n_shingles`` 0) and are
linked with nothing; a text of fewer than ``width`` words is one shingle; an empty table
gives an empty result; ``doc_id`` is a key - rows that repeat it must repeat its text, and
each gives a row; null ids link with nothing and are kept; whole texts are read; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import U64, HashCache, ascii_words, mix64
from larkspan.operators.graph import connected_components
from larkspan.sources import materialize, table

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=U64)


def shingle_set(text: str | None, width: int = 5, cache: HashCache | None = None) -> np.ndarray:
    """The sorted distinct hashes of the text's ``width``-word shingles."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, U64)
    hashed = (HashCache() if cache is None else cache).array(words)
    n = max(1, len(words) - width + 1)
    sums = np.full(n, len(words) if len(words) < width else width, dtype=U64)
    for i in range(min(width, len(words))):
        sums = mix64(sums) * _ODD[0] + hashed[i : i + n]
    return np.unique(mix64(sums))


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty set, densified."""
    at = ((hashes >> U64(32)) * U64(bins)) >> U64(32)  # ascending with the hashes
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out, full = np.zeros(bins, U64), np.zeros(bins, bool)
    out[at[first]] = hashes[first]
    full[at[first]] = True
    empty = np.flatnonzero(~full).astype(U64)
    tries = 0
    while len(empty):
        tries += 1
        source = (mix64(empty * U64(0x9E3779B97F4A7C15) + U64(tries)) % U64(bins)).astype(np.int64)
        hit = full[source]
        out[empty[hit].astype(np.int64)] = out[source[hit]]
        empty = empty[~hit]
    return out


def band_keys(hashes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The buckets of a sorted, non-empty set: one key for each band of its signature."""
    grid = signature(hashes, rows * bands).reshape(bands, rows)
    sums = np.arange(bands, dtype=U64) * U64(0xA24BAED4963EE407)
    for i in range(rows):
        sums = mix64(sums) + grid[:, i]
    return mix64(sums).view(np.int64)


def sketch(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """``doc_id, n, digest, keys`` of each row of ``docs`` (columns ``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, none = HashCache(), np.zeros(0, np.int64)
        for batch in batches:
            sets = [shingle_set(x.as_py(), width, cache) for x in batch.column(1)]
            keys = [band_keys(x, rows, bands) if len(x) else none for x in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *keys]), pa.int64())),
                ],
                names=["doc_id", "n", "digest", "keys"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, digest binary, keys array<long>")


def shingles(docs: DataFrame, width: int, most: int = 200_000) -> DataFrame:
    """``doc_id, g``: the shingle hashes of each row of ``docs`` (columns ``doc_id, text``); a batch ends with the text that fills it."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            at, held, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(shingle_set(text.as_py(), width, cache).view(np.int64))
                at.append(np.full(len(held[-1]), i))
                size += len(held[-1])
                if size >= most or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(held))], names=["doc_id", "g"])
                    at, held, size = [], [], 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, g long")


def remaining_pairs(open_docs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All pairs ``a, b`` that may be similar of ``open_docs`` (``doc_id, n, c, stray``), one of them a stray, the components different.

    A prefix filter with places: shingles that one set has alone come first in its order and meet nothing.
    """
    wanted = open_docs.select(F.col("doc_id").alias("w_id"), "n", "c", "stray")
    each = materialize(shingles(texts.join(wanted.select("w_id"), F.col("doc_id") == F.col("w_id"), "left_semi"), width), "shingles")
    common = each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select(F.col("g").alias("c_g"), "df")
    met = each.join(materialize(common, "common"), F.col("g") == F.col("c_g")).select("doc_id", "g", "df")
    met = met.join(wanted, F.col("doc_id") == F.col("w_id")).select("doc_id", "n", "c", "stray", "g", "df")
    own = Window.partitionBy("doc_id")
    place = F.row_number().over(own.orderBy("df", "g")) - 1 + F.col("n") - F.count(F.lit(1)).over(own)
    index = met.select("g", "doc_id", "n", "c", "stray", place.alias("at")).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    index = materialize(index, "prefixes")
    x = index.filter("stray").select(*[F.col(k).alias(f"x_{k}") for k in ("g", "doc_id", "n", "c", "at")])
    most = F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at"))  # what the sets can share from here on
    pairs = x.join(
        index,
        (F.col("x_g") == F.col("g"))
        & (F.col("x_c") != F.col("c"))
        & (~F.col("stray") | (F.col("x_doc_id") < F.col("doc_id")))
        & (most * 100 >= (F.col("n") + F.col("x_n") - most) * percent),
    )
    return pairs.select(F.col("doc_id").alias("a"), F.col("x_doc_id").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int, star_rows: int = 64) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar; ``a`` should be the side that repeats."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(star_rows)).cast("int").alias("parts")).select(F.col("a").alias("h"), "parts")
    keyed = pairs.join(spread, F.col("a") == F.col("h")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    hubs = (
        spread.join(texts, F.col("h") == F.col("doc_id"))
        .select(F.col("h").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    )
    members = keyed.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hub, own = HashCache(), None, None
        for batch in batches:
            found = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b is None:
                    if a != hub:
                        hub, own = a, shingle_set(text.as_py(), width, cache)
                    continue
                other = shingle_set(text.as_py(), width, cache)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(other) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(0).type) for x in (zip(*found) if found else ([], []))], names=["a", "b"])

    dealt = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 75,
    rows: int = 6,
    bands: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(sketch(slim, width, rows, bands), "sketches")
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = sets.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    each = reps.select(F.explode("keys").alias("key"), "doc_id", "n")
    shared = each.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    # Written first: the joins below then have a shuffle of their own on either side, which lets hot keys be split.
    shared = materialize(shared.select(F.col("key").alias("s_key")), "keys")
    member = materialize(each.join(shared, F.col("key") == F.col("s_key"), "left_semi").distinct(), "members")

    weight = member.groupBy("doc_id").agg(F.count(F.lit(1)).alias("w")).select(F.col("doc_id").alias("w_id"), "w")
    weighed = member.join(weight, F.col("doc_id") == F.col("w_id"))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("w", F.xxhash64("doc_id").alias("h"), "doc_id", "n")).alias("m"), F.count(F.lit(1)).alias("size"))
    hubs = materialize(hubs.select(F.col("key").alias("h_key"), F.col("m.doc_id").alias("hub"), F.col("m.n").alias("hub_n"), "size"), "hubs")
    fits = (F.col("n") * 100 >= F.col("hub_n") * percent) & (F.col("hub_n") * 100 >= F.col("n") * percent)
    stars = member.join(hubs, F.col("key") == F.col("h_key")).filter((F.col("doc_id") != F.col("hub")) & fits)
    stars = materialize(stars.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    wanted = weight.select("w_id")
    texts = materialize(slim.join(wanted, F.col("doc_id") == F.col("w_id"), "left_semi").dropDuplicates(["doc_id"]), "texts")
    links = materialize(verify(stars, texts, width, percent), "links")
    component = materialize(connected_components(links, "a", "b"), "components")

    labels = component.select(F.col("node").alias("l_id"), "component")
    labelled = member.join(labels, F.col("doc_id") == F.col("l_id"), "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    labelled = materialize(labelled, "labelled")
    parts = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    unsettled = parts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("cs"), F.sum("m").alias("size"))
    unsettled = materialize(unsettled.filter("cs > 1 AND size > 2").select(F.col("key").alias("u_key"), "main"), "unsettled")
    open_docs = labelled.join(unsettled, F.col("key") == F.col("u_key")).groupBy("doc_id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.max(F.col("c") != F.col("main")).alias("stray"))
    open_docs = materialize(open_docs, "open")
    merged = None
    if not open_docs.isEmpty():
        more = materialize(verify(remaining_pairs(open_docs, texts, width, percent), texts, width, percent), "links")
        if not more.isEmpty():  # between components: their labels are the nodes
            of = lambda side: open_docs.select(F.col("doc_id").alias(f"{side}_id"), F.col("c").alias(f"c_{side}"))
            between = more.join(of("a"), F.col("a") == F.col("a_id")).join(of("b"), F.col("b") == F.col("b_id")).select("c_a", "c_b").distinct()
            merged = connected_components(between, "c_a", "c_b").select(F.col("node").alias("m_node"), F.col("component").alias("m_component"))

    joined = sets.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    by_class = classes.join(component, F.col("rep") == F.col("node"), "left").select(
        F.concat(F.lit(b"."), F.col("digest")).alias("c_digest"), F.coalesce("component", "rep").alias("component")
    )
    if merged is not None:
        by_class = by_class.join(merged, F.col("component") == F.col("m_node"), "left").select("c_digest", F.coalesce("m_component", "component").alias("component"))
    out = joined.join(by_class, F.concat(F.lit(b"."), F.col("digest")) == F.col("c_digest"), "left")
    component_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns are those of ``docs``."""
    dropped = near_duplicates(docs, id_col=id_col, **options).filter("NOT kept").select(F.col("doc_id").alias("_lk_dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_lk_dropped"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
