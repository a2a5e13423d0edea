"""Exact deduplication through content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so (after a sentence or line end, between
``min_chunk`` and ``max_chunk`` characters), each chunk becomes a 64-bit identifier, and
two texts are equal when their ordered identifier lists - their recipes - are equal. The
identifiers are verified: every distinct chunk also has a SHA-256 digest, and a document that
holds an identifier that stands for two digests gets its chunks' digests added to its recipe,
within its own row. Only identifiers and digests move between tasks; texts never do, and of a
chunk that many documents share each task sends one row.

Defined results:

* null text counts as the empty text; all such rows form one group
* an empty table gives an empty result
* rows that repeat a ``doc_id`` with the same text count as members of the same group,
  and each of them appears in the result; ``kept`` is true for every row with the kept id
* no text is cut short, whatever its length; a text without any sentence or line end is
  cut every ``max_chunk`` characters
* ties do not exist: the largest ``doc_id`` of a group stays; a null ``doc_id`` stays
  only where no other id is in its group
* other columns of the table are ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import materialize, table

#: Identifiers that stand for two chunks; 64 bits make even one unlikely below billions of distinct chunks. With more than this all recipes get digests.
MAX_LISTED = 10_000


def chunks_of(text: Column, min_chunk: int = 512, max_chunk: int = 4096) -> Column:
    """The array of content-defined chunks of ``text``, in order; joined they give the text."""
    pattern = rf"(?s).{{{min_chunk - 1},{max_chunk - 1}}}?(?:[.!?\n]|\z)|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chunk: int = 512, max_chunk: int = 4096
) -> DataFrame:
    """One row per document: ``doc_id, text_sha256, recipe`` (array of 64-bit ids), ``extra`` (digests, null unless ids collide)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("whole")).select(
        "doc_id", "whole", chunks_of(F.col("whole"), min_chunk, max_chunk).alias("chunks")
    )
    recipes = cut.select(
        "doc_id",
        F.sha2("whole", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"),
        "chunks",
    )
    found = cut.select(F.explode(F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")))).alias("c"))
    colliding = found.groupBy("c.id").agg(F.min("c.digest").alias("low"), F.max("c.digest").alias("high")).filter("low <> high").select("id")
    return _with_digests(recipes, [r["id"] for r in materialize(colliding, "colliding").limit(MAX_LISTED + 1).collect()])


def _with_digests(recipes: DataFrame, colliding: list[int]) -> DataFrame:
    """``recipes`` (with ``chunks``) with ``extra``: the chunks' digests of documents that hold a colliding identifier, of all if too many collide."""
    digests = F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256)))
    if len(colliding) > MAX_LISTED:
        extra = digests
    elif colliding:
        listed = F.array(*[F.lit(x).cast("long") for x in colliding])
        extra = F.when(F.arrays_overlap("recipe", listed), digests)
    else:
        extra = F.lit(None).cast("array<binary>")
    return recipes.select("doc_id", "text_sha256", "recipe", extra.alias("extra"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chunk: int = 512, max_chunk: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``."""
    recipes = chunk_recipes(docs, id_col, text_col, min_chunk, max_chunk)
    groups = (
        recipes.groupBy("recipe", "extra")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    # The group table meets the documents on a key of its own, so both sides are exchanged and
    # a recipe that holds a third of the rows can be split between tasks.
    key = lambda side: F.xxhash64(F.lit(7), side["recipe"], side["extra"])
    left = recipes.withColumn("key", key(recipes))
    right = groups.select(
        key(groups).alias("g_key"), F.col("recipe").alias("g_recipe"), F.col("extra").alias("g_extra"), "keep_id", "group_size"
    )
    same = (left["key"] == right["g_key"]) & (left["recipe"] == right["g_recipe"]) & left["extra"].eqNullSafe(right["g_extra"])
    joined = left.join(right, same, "left")
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is that of a row with a larger id; columns are those of ``docs``.

    Rows with a null id are kept: nothing tells them apart.
    """
    dropped = exact_groups(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_lk_dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_lk_dropped"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
