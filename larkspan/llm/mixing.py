"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed into cells (source, language, topic). Raking multiplies the cells
by one factor per source, per language and per topic in turn until all three marginals of
the token weights have their target shares; a document of a cell is then sampled with the
probability calibrated to the cell: its raked share over its present share, scaled so that
the largest is 1 (``fraction`` scales it further down).

One raking round is one aggregation: the factor of a source needs only that source's own
cells (at most languages x topics rows), and what remains is the small language x topic
matrix, which the driver reads to set its two factor lists. So sources may be many, while
languages and topics must be lists of bounded length (``max_small_cells`` is checked).

Targets: by default each marginal is tempered, share proportional to tokens ** power;
``targets`` gives fixed shares for named values instead (values that it leaves out get 0,
shares are normalised over the values present).

Defined results: a null source, language or topic is a category of its own; null or empty
text has no tokens, weighs nothing, and is drawn with its cell's probability, 1 where the
whole cell has no tokens; an empty table gives an empty result; the draw depends on the
seed and ``doc_id`` alone, so repeated rows are kept or left together and every run, split
or retry gives the same sample; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.sources import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
MISSING = "(none)"


def word_count(text: Column) -> Column:
    """Words of ``text``: runs of anything but blanks and line breaks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")).cast("long")


def register_topic(text: Column) -> Column:
    """A topic where the table names none: the register of the text by its marks and length."""
    length = F.length(text)
    marks = length - F.length(F.translate(text, "#$%&*!", ""))
    lines = length - F.length(F.translate(text, "\n", ""))
    return (
        F.when(text.isNull() | (length == 0), MISSING)
        .when(marks * 20 > length, "marked")
        .when(lines * 120 > length, "listed")
        .when(length < 1500, "short")
        .otherwise("prose")
    )


def _shares(tokens: dict, power: float, fixed: Mapping | None) -> dict:
    raw = {k: (fixed.get(k, 0.0) if fixed is not None else v**power if v > 0 else 0.0) for k, v in tokens.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def rake(
    cells: DataFrame,
    powers: tuple[float, float, float] = (0.6, 0.7, 0.8),
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rounds: int = 8,
    max_small_cells: int = 100_000,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with its raked ``share``; shares sum to 1.

    Rounds fit source, then language, then topic; the topic marginal is exact after the last.
    """
    spark, targets = cells.sparkSession, targets or {}
    small = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("m")).limit(max_small_cells + 1).collect()
    if len(small) > max_small_cells:
        raise ValueError(f"more than {max_small_cells} language x topic cells")
    sums = [{}, {}]
    for row in small:
        for k, name in enumerate(("lang", "topic")):
            sums[k][row[name]] = sums[k].get(row[name], 0) + row["m"]
    goal_l, goal_t = (_shares(sums[k], powers[k + 1], targets.get(n)) for k, n in enumerate(("lang", "topic")))
    by_source = Window.partitionBy("source")
    weighed = cells.withColumn("source_tokens", F.sum("tokens").over(by_source))
    if "source" in targets:
        goal = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets["source"].items() for x in kv]), F.col("source")).cast("double"), F.lit(0.0))
        weighed = weighed.withColumn("goal", goal)
    else:
        weighed = weighed.withColumn("goal", F.pow(F.col("source_tokens").cast("double"), F.lit(float(powers[0]))))
    once = F.row_number().over(by_source.orderBy("lang", "topic")) == 1
    weighed = materialize(weighed.withColumn("first", once), "cells")
    total = weighed.filter("first AND source_tokens > 0").agg(F.sum("goal")).first()[0] or 1.0
    b, c = dict.fromkeys(goal_l, 1.0), dict.fromkeys(goal_t, 1.0)

    def factored(b: dict, c: dict) -> DataFrame:
        pairs = [F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["topic"]).alias("topic"), F.lit(b[r["lang"]] * c[r["topic"]]).alias("f")) for r in small]
        return F.broadcast(spark.range(1).select(F.inline(F.array(*pairs))))  # at most max_small_cells rows

    def fitted() -> DataFrame:
        w = weighed.join(factored(b, c), ["lang", "topic"])
        fit = F.sum(F.col("tokens") * F.col("f")).over(by_source)
        return w.withColumn("a", F.when(fit > 0, F.col("goal") / F.lit(total) / fit).otherwise(0.0))

    if not small:
        return cells.withColumn("share", F.lit(0.0))
    for _ in range(rounds):
        last = fitted()
        matrix = {(r["lang"], r["topic"]): r["m"] for r in last.groupBy("lang", "topic").agg(F.sum(F.col("tokens") * F.col("a")).alias("m")).collect()}
        for name in goal_l:
            have = sum(v * c[t] for (k, t), v in matrix.items() if k == name)
            b[name] = goal_l[name] / have if have > 0 else 0.0
        for name in goal_t:
            have = sum(v * b[k] for (k, t), v in matrix.items() if t == name)
            c[name] = goal_t[name] / have if have > 0 else 0.0
    final = last.drop("f").join(factored(b, c), ["lang", "topic"])
    return final.select("source", "lang", "topic", "tokens", (F.col("tokens") * F.col("a") * F.col("f")).alias("share"))


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    seed: int = 11,
    fraction: float = 1.0,
    **raking,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, lang, topic, tokens, probability, kept``."""
    text = F.col(text_col).cast("string")
    name = lambda x: F.coalesce(x.cast("string"), F.lit(MISSING))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        name(F.col(source_col)).alias("source"),
        name(F.col(lang_col)).alias("lang"),
        name(register_topic(text) if topic is None else topic).alias("topic"),
        word_count(text).alias("tokens"),
    )
    slim = materialize(slim, "mixing")
    cells = slim.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    raked = materialize(rake(cells, **raking), "raked")
    sums = raked.agg(F.sum("tokens"), F.max(F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")))).first()
    total, most = sums[0] or 1, (sums[1] or 1.0)
    odds = raked.select(
        "source",
        "lang",
        "topic",
        F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens") / F.lit(most) * F.lit(fraction)).otherwise(1.0).alias("probability"),
    )
    return slim.join(odds, ["source", "lang", "topic"]).select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "tokens",
        F.round("probability", 6).alias("probability"),
        (uniform(seed, F.col("doc_id")) < F.col("probability")).alias("kept"),
    )


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the calibrated draw keeps; columns are those of ``docs``."""
    kept = mix(docs, id_col=id_col, **options).filter("kept").select(F.col("doc_id").alias("_lk_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_lk_kept"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle(powers=(0.6, 0.7, 0.8), rounds=8, seed=11) -> str:
    parts = [
        """d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN text IS NULL OR length(text) = 0 THEN '(none)'
       WHEN (length(text) - length(translate(text, '#$%&*!', ''))) * 20 > length(text) THEN 'marked'
       WHEN (length(text) - length(replace(text, chr(10), ''))) * 120 > length(text) THEN 'listed'
       WHEN length(text) < 1500 THEN 'short' ELSE 'prose' END AS topic,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
    ]
    for k, name in enumerate(("source", "lang", "topic")):
        parts.append(
            f"goal_{name} AS MATERIALIZED (SELECT {name}, w / sum(w) OVER () AS goal FROM "
            f"(SELECT {name}, CASE WHEN sum(n) > 0 THEN pow(sum(n), {powers[k]}) ELSE 0 END AS w FROM cells GROUP BY {name}))"
        )
    state = "(SELECT source, lang, topic, n, n AS w FROM cells)"
    for r in range(rounds):
        for name in ("source", "lang", "topic"):
            step = f"w{r}_{name}"
            parts.append(
                f"{step} AS MATERIALIZED (SELECT source, lang, topic, n, CASE WHEN s > 0 THEN w * goal / s ELSE 0 END AS w FROM "
                f"(SELECT *, sum(w) OVER (PARTITION BY {name}) AS s FROM {state}) JOIN goal_{name} USING ({name}))"
            )
            state = step
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
p AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN w / n / (SELECT max(w / n) FROM {state} WHERE n > 0) ELSE 1 END AS p FROM {state})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p, 6) AS probability,
  ('0x' || substr(md5('{seed}:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    )


ORACLE = _oracle()
