"""Text and entity-resolution queries: documents, part names, and a two-source corpus made of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import text as tx
from larkspan.operators import entity
from larkspan.sources import table


def _subject(k):
    letter = lambda n: F.char(n % 26 + 97)
    return F.concat(F.lit("Corp"), F.upper(letter(F.floor(k / 676))), letter(F.floor(k / 26)), letter(k), F.lit("tech"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a question from two sources, up to two days apart."""
    # Dealt over all cores first: the table may be one small file.
    c = table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    k, name = F.col("c_custkey"), _subject(F.col("c_custkey"))
    day = lambda n: F.date_add(F.lit("2026-01-01").cast("date"), n.cast("int")).cast("timestamp")
    # Both sources from one read: as two sides of a union the table is read and dealt once for each.
    of = lambda a, b: F.when(F.col("side") == 0, a).otherwise(b)
    return c.select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select(
        F.concat(of(F.lit("a"), F.lit("b")), k.cast("string")).alias("id"),
        of(F.lit("alpha"), F.lit("beta")).alias("source"),
        F.concat(of(F.lit("Will "), F.lit("")), name, of(F.lit(" report revenue above $5B in Q3?"), F.lit(" Q3 revenue over $5B?"))).alias("text"),
        of(day(k % 365), day(k % 365 + k % 3)).alias("ts"),
        (of(F.lit(0.40), F.lit(0.41)) + (k % 5) / 100).alias("value"),
        (2 * k + F.col("side")).alias("idx"),
    )


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize(F.col("text")), 256).alias("normal_sha"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize(F.col("p_name")).alias("normal"), F.array_join(tx.tokenize(F.col("p_name")), " ").alias("tokens"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tx.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_sha"))


def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.proper_nouns(F.col("text")), " ").alias("nouns"))


def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("id", entity.iso_week_blocker()(r).alias("block"))


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.block_size_report(records(spark, sf_dir), entity.iso_week_blocker()).withColumn("ratio", F.round("ratio", 9))


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.resolve(records(spark, sf_dir)).comparisons


def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.scored_pairs(entity.last_of_each_id(records(spark, sf_dir)), None, entity.iso_week_blocker(), digits=6)


def pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.resolve(records(spark, sf_dir)).label_counts


def token_set_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", tx.normalize(F.col("p_name")).alias("n"), "p_type")
    other = F.concat_ws(" ", F.lower("p_type"), F.substring("n", 1, 5), F.reverse("n"))
    return p.select("p_partkey", F.round(tx.token_set_ratio(F.col("n"), other), 6).alias("ratio"), tx.lcs_length(F.col("n"), other).cast("long").alias("lcs"))


def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("value"))
    return entity.last_of_each_id(o)


def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.resolve(records(spark, sf_dir)).assignments.select("id", "cluster_id", "size")


def clusters_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    forced = c.filter("c_custkey % 7 = 0").select(F.concat(F.lit("b"), k.cast("string")).alias("left"), F.concat(F.lit("x"), F.floor(k / 14).cast("string")).alias("right"))
    blocked = c.filter("c_custkey % 5 = 0").select(F.concat(F.lit("b"), k.cast("string")).alias("left"), F.concat(F.lit("a"), k.cast("string")).alias("right"))
    return entity.resolve(records(spark, sf_dir), forced=forced, blocked=blocked).assignments.select("id", "cluster_id", "size")


def matched_within(records_: DataFrame, scorer: entity.Scorer | None = None) -> DataFrame:
    """All matched pairs of two sources, exactly."""
    return entity.label_pairs(entity.near_pairs(records_, scorer, entity.THRESHOLD)).filter("label = 'matched'")


def _found(r: DataFrame) -> DataFrame:
    return entity.label_pairs(entity.scored_pairs(r, None, entity.iso_week_blocker(), min_confidence=entity.THRESHOLD)).filter("label = 'matched'")


def all_pairs_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = entity.prepared(entity.spread(records(spark, sf_dir)))
    return entity.recall(_found(r), matched_within(r)).withColumn("recall", F.round("recall", 9))


def missed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.missed_by_blocks(records(spark, sf_dir), entity.iso_week_blocker())


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, part_names, text_tokens, proper_nouns, block_keys, block_sizes, pair_counts, pair_score, pair_labels, token_set_ratios, record_dedup,
        entity_clusters, clusters_with_overrides, all_pairs_recall, missed_pairs,
    )
}

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_OPEN = ", ".join(f"'{w}'" for w in tx.OPENERS)
_PUNCT = tx.PUNCTUATION.replace("'", "''")


def _words(t: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower(translate(coalesce({t}, ''), '{_PUNCT}', '{' ' * 32}')), '[\\s\\x{{A0}}\\x{{85}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+'), "
        f"lambda w: w <> '' AND w NOT IN ({_STOP}))"
    )


def _tokens(t: str) -> str:
    return f"list_sort(list_distinct(list_filter({_words(t)}, lambda w: length(w) >= 2)))"


def _nouns(t: str) -> str:
    # Whole words first: this dialect's \\b only knows ASCII, and would end a word before an accented letter.
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(coalesce({t}, ''), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]{{3,}}') AND w NOT IN ({_OPEN}))))"


def _lcs(a: str, b: str) -> str:
    """Bit-parallel subsequence over BIGINT; ``a`` is shorter than 62."""
    masks = f"list_transform(string_split({b}, ''), lambda c: CAST(coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN 1::BIGINT << (i - 1) ELSE 0 END)), 0) AS BIGINT))"
    full = f"((1::BIGINT << length({a})) - 1)"
    folded = f"list_reduce(list_concat([{full}], {masks}), lambda v, x: ((v + (v & x)) | (v - (v & x))) & {full})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({folded}) END"


def _fuzz_ctes(source: str) -> str:
    """From ``source`` (key, na, nb: normalised texts) to ``fz`` (key, fuzz)."""
    return f"""f1 AS (SELECT *, list_distinct(list_filter(string_split(na, ' '), lambda w: w <> '')) AS wa, list_distinct(list_filter(string_split(nb, ' '), lambda w: w <> '')) AS wb FROM {source}),
f2 AS (SELECT *, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS i, array_to_string(list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))), ' ') AS ra,
  array_to_string(list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))), ' ') AS rb FROM f1),
f3 AS (SELECT *, CASE WHEN length(ra) <= length(rb) THEN ra ELSE rb END AS sa, CASE WHEN length(ra) <= length(rb) THEN rb ELSE ra END AS sb,
  length(i) + CASE WHEN length(i) > 0 THEN 1 ELSE 0 END AS h FROM f2),
fz AS (SELECT *, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN length(i) > 0 AND (length(ra) = 0 OR length(rb) = 0) THEN 100.0
  ELSE greatest(200.0::DOUBLE * (h + {_lcs('sa', 'sb')}) / nullif(2 * h + length(ra) + length(rb), 0),
    CASE WHEN length(i) > 0 THEN greatest(200.0::DOUBLE * length(i) / (length(i) + h + length(ra)), 200.0::DOUBLE * length(i) / (length(i) + h + length(rb))) ELSE 0 END) END AS fuzz FROM f3)"""


def _records_sql() -> str:
    return f"""k AS (SELECT c_custkey AS k, 'Corp' || upper(chr(CAST(c_custkey // 676 % 26 + 97 AS INTEGER))) || chr(CAST(c_custkey // 26 % 26 + 97 AS INTEGER)) || chr(CAST(c_custkey % 26 + 97 AS INTEGER)) || 'tech' AS s FROM customer),
r AS (SELECT 'a' || k AS id, 'alpha' AS source, 'Will ' || s || ' report revenue above $5B in Q3?' AS text, DATE '2026-01-01' + CAST(k % 365 AS INTEGER) AS d, 0.40::DOUBLE + (k % 5) / 100.0::DOUBLE AS value, 2 * k AS idx FROM k
  UNION ALL SELECT 'b' || k, 'beta', s || ' Q3 revenue over $5B?', DATE '2026-01-01' + CAST(k % 365 + k % 3 AS INTEGER), 0.41::DOUBLE + (k % 5) / 100.0::DOUBLE, 2 * k + 1 FROM k),
q AS MATERIALIZED (SELECT *, lpad(CAST(isoyear(d) AS VARCHAR), 4, '0') || 'W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS block, {_words('text')} AS w, {_nouns('text')} AS nouns FROM r)"""


def _pairs_sql(blocked: bool = True) -> str:
    on = "a.idx < b.idx AND a.source <> b.source AND " + ("a.block = b.block" if blocked else "abs(a.d - b.d) <= 14")  # the score's own limit
    return f"""{_records_sql()},
p1 AS (SELECT least(a.id, b.id) AS "left", greatest(a.id, b.id) AS "right", array_to_string(a.w, ' ') AS na, array_to_string(b.w, ' ') AS nb, a.nouns AS n1, b.nouns AS n2,
  len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS jaccard, abs(a.d - b.d) / 1.0::DOUBLE AS days, abs(a.value - b.value) AS dv FROM q a JOIN q b ON {on}),
p2 AS (SELECT * FROM p1 WHERE jaccard >= 0.30 AND days <= 14),
{_fuzz_ctes('p2')},
p3 AS (SELECT *, CAST(len(list_filter(n1, lambda x: NOT list_contains(n2, x))) + len(list_filter(n2, lambda x: NOT list_contains(n1, x))) AS BIGINT) AS noun_diff FROM fz WHERE fuzz >= 75),
p AS (SELECT "left", "right", fuzz, jaccard, days, noun_diff, greatest(0.0, least(1.0, 0.60::DOUBLE * fuzz / 100 + 0.30::DOUBLE * jaccard + 0.10::DOUBLE * (1 - days / 14) - 0.12::DOUBLE * noun_diff
  + CASE WHEN dv <= 0.05::DOUBLE THEN 0.03::DOUBLE ELSE 0 END)) AS confidence FROM p3)"""


_COMPONENTS = """n AS (SELECT l AS id FROM e UNION SELECT r FROM e), b AS (SELECT l AS x, r AS y FROM e UNION SELECT r, l FROM e),
reach AS (SELECT id AS x, id AS y FROM n UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x),
comp AS (SELECT x AS id, min(y) AS c FROM reach GROUP BY x), named AS (SELECT c, 'cl:' || substr(sha256(string_agg(id, '|' ORDER BY id)), 1, 10) AS cluster_id, count(*) AS size FROM comp GROUP BY c)
SELECT comp.id, named.cluster_id, named.size FROM comp JOIN named USING (c)"""
_MATCHED = """SELECT "left" AS l, "right" AS r FROM p WHERE confidence >= 0.65"""


def _recall_ctes() -> str:
    whole, part = _pairs_sql(False), _pairs_sql()
    return f"""t AS (WITH {whole} {_MATCHED}), f AS (WITH {part} {_MATCHED})"""


ORACLES = {
    "text_normalize": f"SELECT doc_id, sha256(array_to_string({_words('text')}, ' ')) AS normal_sha FROM documents",
    "part_names": f"SELECT p_partkey, array_to_string({_words('p_name')}, ' ') AS normal, array_to_string({_tokens('p_name')}, ' ') AS tokens FROM part",
    "text_tokens": f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, sha256(array_to_string({_tokens('text')}, ' ')) AS tokens_sha FROM documents",
    "proper_nouns": f"SELECT doc_id, array_to_string({_nouns('text')}, ' ') AS nouns FROM documents",
    "block_keys": f"WITH {_records_sql()} SELECT id, block FROM q",
    "block_sizes": f"""WITH {_records_sql()}, s AS (SELECT block, count(*) AS n FROM q GROUP BY block)
SELECT count(*) AS blocks, CAST(sum(n) AS BIGINT) AS records, max(n) AS largest, quantile_disc(n, 0.5) AS median, count(*) FILTER (WHERE n = 1) AS singletons, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs,
  CAST(sum(n) * (sum(n) - 1) // 2 AS BIGINT) AS all_pairs, round(sum(n * (n - 1) // 2) / CAST(sum(n) * (sum(n) - 1) // 2 AS DOUBLE), 9) AS ratio FROM s""",
    "pair_counts": f"WITH {_records_sql()} SELECT count(*) AS comparisons FROM q a JOIN q b ON a.block = b.block AND a.idx < b.idx AND a.source <> b.source",
    "pair_score": f'WITH {_pairs_sql()} SELECT "left", "right", round(confidence, 6) AS confidence, round(fuzz, 6) AS fuzz, round(jaccard, 6) AS jaccard, noun_diff, round(days, 6) AS days FROM p',
    "pair_labels": f"WITH {_pairs_sql()} SELECT CASE WHEN confidence >= 0.65 THEN 'matched' WHEN confidence >= 0.65::DOUBLE - 0.10::DOUBLE THEN 'near_miss' ELSE 'none' END AS label, count(*) AS n FROM p GROUP BY 1",
    "token_set_ratios": f"""WITH s AS (SELECT p_partkey, na, lower(p_type) || ' ' || substr(na, 1, 5) || ' ' || reverse(na) AS nb FROM (SELECT *, array_to_string({_words('p_name')}, ' ') AS na FROM part)), {_fuzz_ctes('s')}
SELECT p_partkey, round(fuzz, 6) AS ratio, CAST({_lcs('na', 'nb')} AS BIGINT) AS lcs FROM fz""",
    "record_dedup": """SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderstatus, o_orderkey) AS source, min(o_orderkey) AS idx, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey""",
    "entity_clusters": f"WITH RECURSIVE {_pairs_sql()}, e AS ({_MATCHED}), {_COMPONENTS}",
    "clusters_with_overrides": f"""WITH RECURSIVE {_pairs_sql()}, e AS (SELECT l, r FROM ({_MATCHED}) m WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 5 = 0 AND l = 'a' || c_custkey AND r = 'b' || c_custkey)
  UNION SELECT 'b' || c_custkey, 'x' || c_custkey // 14 FROM customer WHERE c_custkey % 7 = 0), {_COMPONENTS}""",
    "all_pairs_recall": f"""WITH {_recall_ctes()} SELECT count(*) AS truth_pairs, count(f.l) AS hit, count(*) - count(f.l) AS missed, round(coalesce(count(f.l) / CAST(nullif(count(*), 0) AS DOUBLE), 1), 9) AS recall
FROM t LEFT JOIN f ON t.l = f.l AND t.r = f.r""",
    "missed_pairs": f'WITH {_recall_ctes()} SELECT t.l AS "left", t.r AS "right" FROM t ANTI JOIN f ON t.l = f.l AND t.r = f.r',
}
