"""Query catalog: the operators instantiated on the given test tables.

Each query reads whole tables (or frames Spark derives from them) and returns
a DataFrame; its DuckDB twin is registered next to it when the computation
is SQL-expressible. Doubles are rounded (6 places; 4 for sums over many rows)
on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clusterlens.functions import text as T
from clusterlens.operators import clean as C
from clusterlens.operators import features as FE
from clusterlens.operators import lift as L
from clusterlens.operators import profile as P
from clusterlens.operators import validate as V
from clusterlens.plans.registry import register, rounded, tbl, settled

WS_SQL = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"


def _words(col="p_name"):
    return F.split(F.col(col), " ")


def docs_labels(spark, sf):
    return tbl(spark, sf, "documents").join(tbl(spark, sf, "labels"), "doc_id", "left")


# ---------------------------------------------------------------- B0: lift
@register("lift_by_cluster", """
WITH base AS (SELECT lang AS cluster, coalesce(CAST(source AS VARCHAR), 'missing') AS value FROM documents),
cv AS (SELECT cluster, value, count(*) AS cnt FROM base GROUP BY 1, 2),
cs AS (SELECT cluster, count(*) AS n_c FROM base GROUP BY 1),
gv AS (SELECT value, count(*) AS g FROM base GROUP BY 1),
j AS (SELECT cv.cluster, cv.value, cv.cnt, cv.cnt / cs.n_c AS cs_, gv.g / (SELECT count(*) FROM base) AS gs_
      FROM cv JOIN cs ON cv.cluster = cs.cluster JOIN gv ON cv.value = gv.value),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, value) AS rk FROM j)
SELECT cluster, value, cnt AS "count", round(cs_, 6) + 0.0 AS cluster_share, round(gs_, 6) + 0.0 AS global_share,
       round(CASE WHEN gs_ > 0 THEN cs_ / gs_ END, 6) + 0.0 AS lift_vs_global, CAST(rk AS INTEGER) AS "rank"
FROM r WHERE rk <= 5
""")
def q_lift_by_cluster(spark, sf):
    return rounded(L.category_lift(tbl(spark, sf, "documents"), "lang", "source", top_n=5))


@register("multilabel_lift", """
WITH base AS (SELECT p_partkey, p_type AS cluster, string_split(p_name, ' ') AS tags FROM part),
ex AS (SELECT cluster, CASE WHEN trim(t) = '' THEN 'missing' ELSE trim(t) END AS value
       FROM (SELECT cluster, unnest(CASE WHEN tags IS NULL OR len(tags) = 0 THEN ['missing'] ELSE tags END) AS t FROM base)),
cv AS (SELECT cluster, value, count(*) AS cnt FROM ex GROUP BY 1, 2),
cs AS (SELECT cluster, count(*) AS n_c FROM base GROUP BY 1),
gv AS (SELECT value, sum(cnt) AS g FROM cv GROUP BY 1),
j AS (SELECT cv.cluster, cv.value, cv.cnt, cv.cnt / cs.n_c AS cs_, gv.g / (SELECT count(*) FROM base) AS gs_
      FROM cv JOIN cs ON cv.cluster = cs.cluster JOIN gv ON cv.value = gv.value),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, value) AS rk FROM j)
SELECT cluster, value, cnt AS "count", round(cs_, 6) + 0.0 AS cluster_share, round(gs_, 6) + 0.0 AS global_share,
       round(CASE WHEN gs_ > 0 THEN cs_ / gs_ END, 6) + 0.0 AS lift_vs_global, CAST(rk AS INTEGER) AS "rank"
FROM r WHERE rk <= 8
""")
def q_multilabel_lift(spark, sf):
    return rounded(L.multilabel_lift(tbl(spark, sf, "part"), "p_type", _words(), top_n=8))


# ---------------------------------------------------------------- B1: clean
@register("normalize_text", f"""
SELECT doc_id, nullif(trim(regexp_replace(text, '{WS_SQL}', ' ', 'g')), '') AS text_clean FROM documents
""")
def q_normalize_text(spark, sf):
    return tbl(spark, sf, "documents").select("doc_id", T.clean_label("text").alias("text_clean"))


_EVT_TOKEN_SQL = "CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END"


def _events_tokenized(spark, sf):
    e = tbl(spark, sf, "events")
    return e.withColumn("event_type", F.when(F.col("event_type") == "error", F.lit("UNKNOWN"))
                        .otherwise(F.col("event_type")))


@register("missing_tokens", f"""
SELECT event_id, CASE WHEN lower(trim(et)) IN ('unknown', '') THEN NULL ELSE et END AS event_type
FROM (SELECT event_id, {_EVT_TOKEN_SQL} AS et FROM events)
""")
def q_missing_tokens(spark, sf):
    e = _events_tokenized(spark, sf)
    return C.replace_missing_tokens(e, ["event_type"]).select("event_id", "event_type")


@register("missing_token_counts", f"""
SELECT 'event_type' AS "column",
       count(*) FILTER (WHERE et IS NOT NULL AND lower(trim(et)) IN ('unknown', '')) AS newly_missing,
       count(*) FILTER (WHERE et IS NULL OR lower(trim(et)) IN ('unknown', '')) AS null_after
FROM (SELECT {_EVT_TOKEN_SQL} AS et FROM events)
""")
def q_missing_token_counts(spark, sf):
    return C.newly_missing_counts(_events_tokenized(spark, sf), ["event_type"])


_NUM_RE = r"^[+-]?((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"


def _coerce_sql(x):
    s = f"lower(trim(regexp_replace({x}, '{WS_SQL}', ' ', 'g')))"
    return f"CASE WHEN regexp_matches({s}, '{_NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END"


@register("coerce_numeric", f"""
SELECT event_id, {_coerce_sql("json_extract_string(props, '$.k')")} AS k_num, {_coerce_sql('props')} AS props_num
FROM events
""")
def q_coerce_numeric(spark, sf):
    e = tbl(spark, sf, "events")
    return e.select("event_id", T.coerce_numeric(F.get_json_object("props", "$.k")).alias("k_num"),
                    T.coerce_numeric("props").alias("props_num"))


@register("coerce_brand", f"""
SELECT p_partkey, {_coerce_sql("replace(p_brand, 'Brand#', '')")} AS brand_num FROM part
""")
def q_coerce_brand(spark, sf):
    p = tbl(spark, sf, "part")
    return p.select("p_partkey", T.coerce_numeric(F.regexp_replace("p_brand", "Brand#", "")).alias("brand_num"))


_DUR_SQL = """CASE WHEN value < 5 THEN CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || ' min'
 WHEN value < 100 THEN CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) || ' hr  '
      || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'min per ep'
 ELSE 'Ep ' || CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) || ' HR' END"""


@register("parse_duration", f"""
WITH d AS (SELECT event_id, {_DUR_SQL} AS duration_text FROM events),
p AS (SELECT event_id, duration_text,
             TRY_CAST(nullif(regexp_extract(lower(trim(duration_text)), '(\\d+)\\s*hr', 1), '') AS BIGINT) AS h,
             TRY_CAST(nullif(regexp_extract(lower(trim(duration_text)), '(\\d+)\\s*min', 1), '') AS BIGINT) AS m
      FROM d)
SELECT event_id, duration_text,
       CASE WHEN coalesce(h, 0) * 60 + coalesce(m, 0) > 0 THEN CAST(coalesce(h, 0) * 60 + coalesce(m, 0) AS DOUBLE) END
         AS duration_minutes,
       TRY_CAST(nullif(regexp_extract(duration_text, '(\\d+)', 1), '') AS DOUBLE) AS first_int
FROM p
""")
def q_parse_duration(spark, sf):
    dur = F.expr(_DUR_SQL.replace("VARCHAR", "STRING"))
    e = tbl(spark, sf, "events").select("event_id", dur.alias("duration_text"))
    return e.select("event_id", "duration_text", T.parse_duration_minutes("duration_text").alias("duration_minutes"),
                    T.first_integer("duration_text").alias("first_int"))


_RAW_ML_SQL = "upper(replace(p_name, ' ', ',  ')) || ', unknown, '"


@register("normalize_multilabel", f"""
WITH n AS (SELECT p_partkey,
  list_sort(list_distinct(list_filter(list_transform(string_split({_RAW_ML_SQL}, ','),
     lambda t: lower(trim(regexp_replace(t, '{WS_SQL}', ' ', 'g')))), lambda t: t <> '' AND t <> 'unknown'))) AS tags
  FROM part)
SELECT p_partkey, CASE WHEN len(tags) = 0 THEN 'missing' ELSE array_to_string(tags, '|') END AS labels,
       CAST(len(tags) AS BIGINT) AS n_labels
FROM n
""")
def q_normalize_multilabel(spark, sf):
    raw = F.concat(F.upper(F.regexp_replace("p_name", " ", ",  ")), F.lit(", unknown, "))
    p = tbl(spark, sf, "part").select("p_partkey", T.normalize_multilabel(raw).alias("labels"))
    return p.select("p_partkey", "labels", F.size(T.parse_multilabel("labels")).cast("long").alias("n_labels"))


@register("leading_token", """
SELECT o_orderkey, lower(trim(coalesce(o_orderpriority, 'missing'))) AS priority_cat,
       CASE WHEN o_orderpriority IS NULL OR lower(trim(o_orderpriority)) IN ('unknown', 'missing', '') THEN 'missing'
            ELSE split_part(lower(trim(o_orderpriority)), ' ', 1) END AS priority_lead
FROM orders
""")
def q_leading_token(spark, sf):
    o = tbl(spark, sf, "orders")
    return o.select("o_orderkey", T.normalize_category("o_orderpriority").alias("priority_cat"),
                    T.leading_token("o_orderpriority").alias("priority_lead"))


@register("dedup_first", """
SELECT event_id, user_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1
""")
def q_dedup_first(spark, sf):
    e = tbl(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return C.dedup(e, ["user_id"], "event_id", "first")


@register("dedup_last", """
SELECT event_id, user_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def q_dedup_last(spark, sf):
    e = tbl(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return C.dedup(e, ["user_id"], "event_id", "last")


@register("dedup_none", """
SELECT doc_id, lang, source FROM
 (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM documents) WHERE c = 1
""")
def q_dedup_none(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return C.dedup(d, ["text"], "doc_id", "none").select("doc_id", "lang", "source")


@register("dedup_text_first", """
SELECT doc_id, lang, source FROM
 (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def q_dedup_text_first(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return C.dedup(d, ["text"], "doc_id", "first").select("doc_id", "lang", "source")


@register("duplicate_key_count", """
SELECT CAST(count(*) - count(DISTINCT text) - (CASE WHEN count(*) > count(text) THEN 1 ELSE 0 END) AS BIGINT)
  AS duplicate_rows FROM documents
""")
def q_duplicate_key_count(spark, sf):
    return P.duplicate_key_count(tbl(spark, sf, "documents"), "text")


@register("validate_report", """
WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT text AS k_text, count(*) AS c FROM j GROUP BY 1),
f AS (SELECT (text IS NULL OR trim(CAST(text AS VARCHAR)) = '') AS missing_text,
             (source IS NULL OR trim(CAST(source AS VARCHAR)) = '') AS missing_source,
             coalesce(NOT (CAST(n_chars AS DOUBLE) BETWEEN 0 AND 10000), false) AS invalid_n_chars,
             coalesce(CAST(quality AS DOUBLE) <= 0, false) AS invalid_quality,
             coalesce(k.c > 1, false) AS duplicate_text
      FROM j LEFT JOIN k ON j.text IS NOT DISTINCT FROM k.k_text)
SELECT count(*) AS "rows", count(*) FILTER (WHERE missing_text) AS missing_text,
       count(*) FILTER (WHERE missing_source) AS missing_source,
       count(*) FILTER (WHERE invalid_n_chars) AS invalid_n_chars,
       count(*) FILTER (WHERE invalid_quality) AS invalid_quality,
       count(*) FILTER (WHERE duplicate_text) AS duplicate_text,
       count(*) FILTER (WHERE missing_text OR missing_source) AS rejected_rows,
       count(*) FILTER (WHERE missing_text OR missing_source OR invalid_n_chars OR invalid_quality OR duplicate_text)
         AS warning_rows
FROM f
""")
def q_validate_report(spark, sf):
    report, _ = V.validate(docs_labels(spark, sf), key="text", name="source", ranges={"n_chars": (0, 10000)},
                           positive=["quality"])
    return report


@register("reject_split", """
WITH k AS (SELECT c_custkey AS kk, count(*) AS c FROM customer GROUP BY 1),
f AS (SELECT c.*, (c_custkey IS NULL OR trim(CAST(c_custkey AS VARCHAR)) = '') AS f1,
             (c_name IS NULL OR trim(CAST(c_name AS VARCHAR)) = '') AS f2,
             coalesce(NOT (CAST(c_nationkey AS DOUBLE) BETWEEN 0 AND 20), false) AS f3,
             coalesce(CAST(c_acctbal AS DOUBLE) < 0, false) AS f4,
             coalesce(k.c > 1, false) AS f5
      FROM customer c LEFT JOIN k ON c.c_custkey IS NOT DISTINCT FROM k.kk)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       concat_ws(',', CASE WHEN f1 THEN 'missing_c_custkey' END, CASE WHEN f2 THEN 'missing_c_name' END,
                 CASE WHEN f3 THEN 'invalid_c_nationkey' END, CASE WHEN f4 THEN 'invalid_c_acctbal' END,
                 CASE WHEN f5 THEN 'duplicate_c_custkey' END) AS rejection_reasons
FROM f WHERE f1 OR f2 OR f3 OR f4 OR f5
""")
def q_reject_split(spark, sf):
    _, rejected = V.validate(tbl(spark, sf, "customer"), key="c_custkey", name="c_name",
                             ranges={"c_nationkey": (0, 20)}, nonneg=["c_acctbal"], strict=True)
    return rejected.withColumn("rejection_reasons", F.array_join("rejection_reasons", ","))


@register("median_impute", """
WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT median(CAST(quality AS DOUBLE)) FROM j)) AS quality,
       coalesce(CAST(toxic AS DOUBLE), (SELECT median(CAST(toxic AS DOUBLE)) FROM j)) AS toxic
FROM j
""")
def q_median_impute(spark, sf):
    j = docs_labels(spark, sf).select("doc_id", "quality", "toxic")
    out, _ = C.median_impute(j, ["quality", "toxic"])
    return rounded(out)


# ---------------------------------------------------------------- B2: profile
_PROFILE_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _profile_sql():
    parts = []
    for c in _PROFILE_COLS:
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) FILTER (WHERE {c} IS NULL) AS null_count,
 count(DISTINCT {c}) AS distinct_count FROM j""")
    return ("WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
            "u AS (" + " UNION ALL ".join(parts) + ") SELECT \"column\", \"rows\", null_count, distinct_count, "
            "null_count / greatest(\"rows\", 1) > 0.3 AS high_missing, "
            "distinct_count / greatest(\"rows\", 1) > 0.2 AS high_cardinality FROM u")


@register("profile_nulls_distinct", _profile_sql())
def q_profile_nulls_distinct(spark, sf):
    return P.null_distinct_profile(docs_labels(spark, sf), _PROFILE_COLS)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql():
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) + 0.0 AS mean,
 round(CASE WHEN count({c}) > 1 THEN stddev_samp({c}) ELSE 0.0 END, 4) + 0.0 AS std,
 round(CAST(min({c}) AS DOUBLE), 4) + 0.0 AS "min", round(median(CAST({c} AS DOUBLE)), 4) + 0.0 AS median,
 round(CAST(max({c}) AS DOUBLE), 4) + 0.0 AS "max" FROM lineitem""" for c in _LI_NUM]
    return " UNION ALL ".join(parts)


@register("profile_numeric", _numeric_sql())
def q_profile_numeric(spark, sf):
    return rounded(P.numeric_summary(tbl(spark, sf, "lineitem"), _LI_NUM), 4)


def _missing_sql():
    parts = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM j" for c in _PROFILE_COLS)
    return f"""WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), u AS ({parts})
SELECT "rank", "column", null_count, null_share FROM (
  SELECT CAST(row_number() OVER (ORDER BY nulls DESC, col) AS INTEGER) AS "rank", col AS "column", nulls AS null_count,
         round(nulls / greatest(n, 1), 6) + 0.0 AS null_share FROM u) WHERE "rank" <= 15"""


@register("missing_top15", _missing_sql())
def q_missing_top15(spark, sf):
    """C-3: the columns with the most nulls."""
    return rounded(P.top_missing(P.null_distinct_profile(docs_labels(spark, sf), _PROFILE_COLS)))


@register("top_categories", """
WITH u AS (SELECT 'p_brand' AS "column", coalesce(CAST(p_brand AS VARCHAR), 'missing') AS value FROM part
           UNION ALL SELECT 'p_type', coalesce(CAST(p_type AS VARCHAR), 'missing') FROM part),
c AS (SELECT "column", value, count(*) AS "count" FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS rk FROM c)
SELECT "column", value, "count", CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 10
""")
def q_top_categories(spark, sf):
    return P.top_values(tbl(spark, sf, "part"), ["p_brand", "p_type"], n=10)


@register("top_tags", """
WITH t AS (SELECT trim(unnest(string_split(coalesce(replace(p_name, ' ', ','), ''), ','))) AS tag FROM part),
c AS (SELECT tag, count(*) AS "count" FROM t WHERE tag <> '' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY "count" DESC, tag) AS rk FROM c)
SELECT tag, "count", CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 20
""")
def q_top_tags(spark, sf):
    p = tbl(spark, sf, "part").select(F.regexp_replace("p_name", " ", ",").alias("p_name"))
    return P.top_tags(p, "p_name", ",", 20)


_HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _hist_sql():
    parts = []
    for c in _HIST_COLS:
        parts.append(f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS x, lo, hi FROM lineitem,
 (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) s WHERE {c} IS NOT NULL""")
    return ("WITH u AS (" + " UNION ALL ".join(parts) + "), b AS (SELECT \"column\", lo, hi, "
            "CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 30), 29) ELSE 0 END AS INTEGER) AS bin FROM u) "
            "SELECT \"column\", bin, round(lo + bin * ((hi - lo) / 30), 6) + 0.0 AS bin_start, "
            "round(lo + (bin + 1) * ((hi - lo) / 30), 6) + 0.0 AS bin_end, count(*) AS \"count\" "
            "FROM b GROUP BY \"column\", lo, hi, bin")


@register("histogram30", _hist_sql())
def q_histogram30(spark, sf):
    return rounded(P.histogram(tbl(spark, sf, "lineitem"), _HIST_COLS, 30))


def _corr_sql():
    parts = []
    for a in _LI_NUM:
        for b in _LI_NUM:
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(coalesce(covar_pop({a}, {b}) /
 nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0),
 0.0), 6) + 0.0 AS corr FROM lineitem""")
    return " UNION ALL ".join(parts)


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return rounded(P.correlation(tbl(spark, sf, "lineitem"), _LI_NUM))


# ---------------------------------------------------------------- B3: features
@register("log_clip", """
SELECT c_custkey, round(CASE WHEN c_acctbal IS NOT NULL THEN ln(1 + greatest(c_acctbal, 0.0)) END, 6) + 0.0
  AS c_acctbal_log1p FROM customer
""")
def q_log_clip(spark, sf):
    return rounded(tbl(spark, sf, "customer").select("c_custkey", T.log1p_clipped("c_acctbal").alias("c_acctbal_log1p")))


@register("tag_vocab", """
WITH t AS (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part),
c AS (SELECT tag, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS rk FROM c)
SELECT tag, n, CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 50
""")
def q_tag_vocab(spark, sf):
    return FE.tag_vocab(tbl(spark, sf, "part"), _words(), 50)


@register("multi_hot", """
WITH v AS (SELECT tag FROM (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS rk
           FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag) WHERE rk <= 50)
SELECT p.p_partkey, 'p_name__' || v.tag AS feature,
       CAST(list_contains(string_split(p.p_name, ' '), v.tag) AS DOUBLE) AS value
FROM part p, v
""")
def q_multi_hot(spark, sf):
    p = tbl(spark, sf, "part")
    vocab = [r["tag"] for r in FE.tag_vocab(p, _words(), 50).collect()]  # <= 50 tags
    wide = p.select("p_partkey", *FE.multi_hot_columns(_words(), "p_name", vocab, "double"))
    names = [c for c in wide.columns if c != "p_partkey"]
    return FE.unpivot_features(wide, ["p_partkey"], names)


@register("onehot_min_freq", """
WITH c AS (SELECT p_brand AS level, count(*) AS cnt FROM part GROUP BY 1),
keep AS (SELECT level FROM c WHERE cnt >= 0.04 * (SELECT count(*) FROM part)),
feats AS (SELECT level, 'categorical__p_brand_' || level AS feature FROM keep
          UNION ALL SELECT NULL, 'categorical__p_brand_infrequent_sklearn'
          WHERE (SELECT count(*) FROM c) > (SELECT count(*) FROM keep))
SELECT p.p_partkey, f.feature,
       CASE WHEN f.level IS NOT NULL THEN CAST(p.p_brand = f.level AS DOUBLE)
            ELSE CAST(p.p_brand IS NOT NULL AND p.p_brand NOT IN (SELECT level FROM keep) AS DOUBLE) END AS value
FROM part p, feats f
""")
def q_onehot_min_freq(spark, sf):
    p = tbl(spark, sf, "part").select("p_partkey", "p_brand")
    levels, infrequent = FE.frequent_levels(p, "p_brand", 0.04)
    wide = p.select("p_partkey", *FE.one_hot_columns("p_brand", levels, infrequent))
    return FE.unpivot_features(wide, ["p_partkey"], [c for c in wide.columns if c != "p_partkey"])


@register("standardize", """
SELECT p_partkey,
  round((p_size - (SELECT avg(p_size) FROM part)) / coalesce(nullif((SELECT stddev_pop(p_size) FROM part), 0), 1), 6)
    + 0.0 AS numeric__p_size,
  round((p_retailprice - (SELECT avg(p_retailprice) FROM part))
    / coalesce(nullif((SELECT stddev_pop(p_retailprice) FROM part), 0), 1), 6) + 0.0 AS numeric__p_retailprice
FROM part
""")
def q_standardize(spark, sf):
    p = tbl(spark, sf, "part")
    stats = FE.standardize_stats(p, ["p_size", "p_retailprice"])
    return rounded(p.select("p_partkey", *FE.standardized_columns(stats)))


# ---------------------------------------------------------------- B3: matrix on part + lineitem aggregates
_PART_NUM = ["p_size", "p_retailprice", "n_lines_log1p", "qty_sum_log1p", "avg_discount"]


def part_input(spark, sf):
    """part LEFT JOIN per-part lineitem aggregates (partial aggregation before the join)."""
    li = tbl(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty_sum"),
        F.avg("l_discount").alias("avg_discount"))
    p = tbl(spark, sf, "part")
    j = p.join(li, p["p_partkey"] == li["l_partkey"], "left")
    return j.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"),
                    "p_retailprice", T.log1p_clipped("n_lines").alias("n_lines_log1p"),
                    T.log1p_clipped("qty_sum").alias("qty_sum_log1p"), "avg_discount")


_PART_INPUT_SQL = """li AS (SELECT l_partkey, count(*) AS n_lines, sum(l_quantity) AS qty_sum, avg(l_discount) AS avg_discount
       FROM lineitem GROUP BY 1),
b AS (SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, CAST(p.p_size AS DOUBLE) AS p_size, p.p_retailprice,
       CASE WHEN li.n_lines IS NOT NULL THEN ln(1 + greatest(CAST(li.n_lines AS DOUBLE), 0.0)) END AS n_lines_log1p,
       CASE WHEN li.qty_sum IS NOT NULL THEN ln(1 + greatest(li.qty_sum, 0.0)) END AS qty_sum_log1p,
       li.avg_discount FROM part p LEFT JOIN li ON p.p_partkey = li.l_partkey)"""


def _matrix_sql(norm="{}"):
    med = ", ".join(f"median({c}) AS m_{c}" for c in _PART_NUM)
    imp = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _PART_NUM)
    st = ", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _PART_NUM)
    num = " UNION ALL ".join(f"SELECT p_partkey, 'numeric__{c}' AS feature, ({c} - a_{c}) / s_{c} AS value FROM i, s"
                             for c in _PART_NUM)
    cat = []
    for c in ["p_type", "p_brand"]:
        cat.append(f"""SELECT i.p_partkey, f.feature, CASE WHEN f.level IS NOT NULL THEN CAST(i.{c} = f.level AS DOUBLE)
  ELSE CAST(i.{c} NOT IN (SELECT level FROM keep_{c}) AS DOUBLE) END AS value FROM i, feats_{c} f""")
    lv = []
    for c in ["p_type", "p_brand"]:
        lv.append(f"""cnt_{c} AS (SELECT {c} AS level, count(*) AS cnt FROM i GROUP BY 1),
keep_{c} AS (SELECT level FROM cnt_{c} WHERE cnt >= 0.01 * (SELECT count(*) FROM i)),
feats_{c} AS (SELECT level, 'categorical__{c}_' || level AS feature FROM keep_{c}
  UNION ALL SELECT NULL, 'categorical__{c}_infrequent_sklearn' WHERE (SELECT count(*) FROM cnt_{c}) > (SELECT count(*) FROM keep_{c}))""")
    return f"""WITH {_PART_INPUT_SQL},
m AS (SELECT {med} FROM b),
i AS (SELECT p_partkey, {norm.format("coalesce(p_type, 'missing')")} AS p_type, {norm.format("coalesce(p_brand, 'missing')")} AS p_brand,
      string_split(p_name, ' ') AS tags, {imp} FROM b, m),
s AS (SELECT {st} FROM i),
{", ".join(lv)},
vocab AS (SELECT tag FROM (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS rk
          FROM (SELECT unnest(tags) AS tag FROM i) GROUP BY tag) WHERE rk <= 50),
longf AS ({num} UNION ALL {" UNION ALL ".join(cat)} UNION ALL
  SELECT i.p_partkey, 'p_name__' || v.tag AS feature, CASE WHEN list_contains(i.tags, v.tag) THEN 1.0 ELSE 0.0 END
  FROM i, vocab v)"""


def _part_matrix(spark, sf):
    return FE.build_features(part_input(spark, sf), ["p_partkey"], numeric=_PART_NUM,
                             categorical=["p_type", "p_brand"], multi_label={"p_name": _words()},
                             min_frequency=0.01, vocab_size=50)


@register("feature_matrix", _matrix_sql() + """
SELECT p_partkey, feature, round(value, 6) + 0.0 AS value FROM longf""")
def q_feature_matrix(spark, sf):
    _, names, wide = _part_matrix(spark, sf)
    return rounded(FE.unpivot_features(wide, ["p_partkey"], names))


@register("matrix_quality", _matrix_sql() + """
SELECT count(DISTINCT p_partkey) AS "rows", count(DISTINCT feature) AS dims,
  count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS null_cells, count(*) FILTER (WHERE value = 0) AS zero_cells,
  round(count(*) FILTER (WHERE value = 0) / count(*), 6) + 0.0 AS zero_cell_ratio,
  count(DISTINCT p_partkey) FILTER (WHERE value IS NULL OR isnan(value)) AS rows_with_null,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM (SELECT list(value ORDER BY feature) AS v FROM longf GROUP BY p_partkey) GROUP BY v))
    AS duplicate_rows,
  count(DISTINCT feature) FILTER (WHERE feature LIKE 'numeric\\_\\_%' ESCAPE '\\') AS numeric_features,
  count(DISTINCT feature) FILTER (WHERE feature LIKE 'categorical\\_\\_%' ESCAPE '\\') AS categorical_features,
  count(DISTINCT feature) FILTER (WHERE feature LIKE 'p\\_name\\_\\_%' ESCAPE '\\') AS multi_hot_features
FROM longf""")
def q_matrix_quality(spark, sf):
    matrix, names, _ = _part_matrix(spark, sf)
    return rounded(FE.matrix_quality(matrix, names))


# ---------------------------------------------------------------- B4: cluster profiles (part, cluster = p_type)
from clusterlens.operators import evaluate as EV  # noqa: E402


@register("cluster_sizes", """
SELECT p_type AS cluster, count(*) AS size, round(count(*) / (SELECT count(*) FROM part), 6) + 0.0 AS proportion
FROM part GROUP BY 1
""")
def q_cluster_sizes(spark, sf):
    return rounded(EV.cluster_sizes(tbl(spark, sf, "part"), "p_type"))


def _cluster_numeric_sql():
    parts = [f"SELECT p_type AS cluster, '{c}' AS col, {c} AS v FROM b" for c in _PART_NUM]
    return f"""WITH {_PART_INPUT_SQL}, u AS ({" UNION ALL ".join(parts)}),
g AS (SELECT col, avg(v) AS gm, coalesce(nullif(stddev_samp(v), 0), 1) AS gs FROM u GROUP BY col),
c AS (SELECT cluster, col, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
      quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75,
      CASE WHEN count(v) > 1 THEN stddev_samp(v) ELSE 0.0 END AS std FROM u GROUP BY cluster, col)"""


@register("cluster_numeric", _cluster_numeric_sql() + """
SELECT cluster, c.col AS "column", n, round(mean, 4) + 0.0 AS mean, round(median, 4) + 0.0 AS median,
  round(p25, 4) + 0.0 AS p25, round(p75, 4) + 0.0 AS p75, round(std, 4) + 0.0 AS std,
  round((mean - gm) / gs, 4) + 0.0 AS z_score_vs_global FROM c JOIN g ON c.col = g.col WHERE n > 0
""")
def q_cluster_numeric(spark, sf):
    return rounded(EV.cluster_numeric(part_input(spark, sf), "p_type", _PART_NUM), 4)


@register("top_z_features", _cluster_numeric_sql() + """,
z AS (SELECT cluster, c.col AS "column", (mean - gm) / gs AS z FROM c JOIN g ON c.col = g.col WHERE n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, "column") AS rk FROM z)
SELECT cluster, "column", round(z, 4) + 0.0 AS z_score_vs_global, CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 4
""")
def q_top_z_features(spark, sf):
    num = EV.cluster_numeric(part_input(spark, sf), "p_type", _PART_NUM)
    return rounded(EV.top_z_features(num, 4), 4)


@register("cluster_zheat", f"""
WITH {_PART_INPUT_SQL}, m AS (SELECT p_type AS cluster, {", ".join(f"avg({c}) AS {c}" for c in _PART_NUM)} FROM b GROUP BY 1)
{" UNION ALL ".join(f"SELECT cluster, '{c}' AS \"column\", round(({c} - (SELECT avg({c}) FROM m)) / coalesce(nullif((SELECT stddev_pop({c}) FROM m), 0), 1), 4) + 0.0 AS z FROM m" for c in _PART_NUM)}
""")
def q_cluster_zheat(spark, sf):
    return rounded(EV.cluster_zheat(part_input(spark, sf), "p_type", _PART_NUM), 4)


_WORDS_CNT_SQL = """w AS (SELECT p_type AS cluster, unnest(string_split(p_name, ' ')) AS value FROM part),
wc AS (SELECT cluster, value, count(*) AS "count" FROM w WHERE value <> 'missing' GROUP BY 1, 2),
bc AS (SELECT p_type AS cluster, coalesce(p_brand, 'missing') AS value, count(*) AS "count" FROM part GROUP BY 1, 2)"""


@register("top_per_cluster", f"""
WITH {_WORDS_CNT_SQL},
r1 AS (SELECT 'genre' AS kind, *, row_number() OVER (PARTITION BY cluster ORDER BY "count" DESC, value) AS rk FROM wc),
r2 AS (SELECT 'type' AS kind, *, row_number() OVER (PARTITION BY cluster ORDER BY "count" DESC, value) AS rk FROM bc)
SELECT kind, cluster, value, "count", CAST(rk AS INTEGER) AS "rank" FROM r1 WHERE rk <= 3
UNION ALL SELECT kind, cluster, value, "count", CAST(rk AS INTEGER) FROM r2 WHERE rk <= 1
""")
def q_top_per_cluster(spark, sf):
    p = tbl(spark, sf, "part")
    words = (p.select(F.col("p_type").alias("cluster"), F.explode(_words()).alias("value"))
             .where(F.col("value") != "missing").groupBy("cluster", "value").agg(F.count(F.lit(1)).alias("count")))
    brands = (p.select(F.col("p_type").alias("cluster"), F.coalesce("p_brand", F.lit("missing")).alias("value"))
              .groupBy("cluster", "value").agg(F.count(F.lit(1)).alias("count")))
    a = EV.top_per_group(words, "cluster", 3).select(F.lit("genre").alias("kind"), "*")
    b = EV.top_per_group(brands, "cluster", 1).select(F.lit("type").alias("kind"), "*")
    return a.unionByName(b)


def _lift_sql(name, tags: bool, top, value="CAST(p_brand AS VARCHAR)"):
    if tags:
        ex = ("SELECT p_type AS cluster, CASE WHEN trim(t) = '' THEN 'missing' ELSE trim(t) END AS value FROM "
              "(SELECT p_type, unnest(string_split(p_name, ' ')) AS t FROM part)")
    else:
        ex = f"SELECT p_type AS cluster, coalesce({value}, 'missing') AS value FROM part"
    return f"""ex_{name} AS ({ex}),
cv_{name} AS (SELECT cluster, value, count(*) AS cnt FROM ex_{name} GROUP BY 1, 2),
cs_{name} AS (SELECT p_type AS cluster, count(*) AS n_c FROM part GROUP BY 1),
gv_{name} AS (SELECT value, sum(cnt) AS g FROM cv_{name} GROUP BY 1),
rec_{name} AS (SELECT * FROM (SELECT cv.cluster, cv.value, cv.cnt, cv.cnt / cs.n_c AS share,
   CASE WHEN gv.g > 0 THEN (cv.cnt / cs.n_c) / (gv.g / (SELECT count(*) FROM part)) END AS lift,
   row_number() OVER (PARTITION BY cv.cluster ORDER BY cv.cnt DESC, cv.value) AS rk
   FROM cv_{name} cv JOIN cs_{name} cs ON cv.cluster = cs.cluster JOIN gv_{name} gv ON cv.value = gv.value)
   WHERE rk <= {top})"""


def _oi_sql(name, share, n):
    return f"""oi_{name} AS (SELECT * FROM (SELECT cluster, value, share, lift,
   row_number() OVER (PARTITION BY cluster ORDER BY lift DESC, share DESC, value) AS oi FROM rec_{name}
   WHERE share >= {share} AND lift IS NOT NULL) WHERE oi <= {n})"""


@register("overindexed", f"""
WITH {_lift_sql('g', True, 8)}, {_lift_sql('t', False, 5)}, {_oi_sql('g', 0.08, 2)}, {_oi_sql('t', 0.15, 1)}
SELECT 'genre' AS kind, cluster, value, round(share, 6) + 0.0 AS cluster_share, round(lift, 6) + 0.0 AS lift_vs_global,
  CAST(oi AS INTEGER) AS oi_rank FROM oi_g
UNION ALL SELECT 'type', cluster, value, round(share, 6) + 0.0, round(lift, 6) + 0.0, CAST(oi AS INTEGER) FROM oi_t
""")
def q_overindexed(spark, sf):
    p = tbl(spark, sf, "part")
    g = EV.overindexed(L.multilabel_lift(p, "p_type", _words(), 8), 0.08, 2).select(F.lit("genre").alias("kind"), "*")
    t = EV.overindexed(L.category_lift(p, "p_type", "p_brand", 5), 0.15, 1).select(F.lit("type").alias("kind"), "*")
    cols = ["kind", "cluster", "value", "cluster_share", "lift_vs_global", "oi_rank"]
    return rounded(g.select(*cols).unionByName(t.select(*cols)))


def _part_profile_frames(spark, sf):
    p = tbl(spark, sf, "part")
    genres = L.multilabel_lift(p, "p_type", _words(), 8)
    types = L.category_lift(p, "p_type", "p_brand", 5)
    labels = EV.interpretation_labels(genres, types, None, p.select(F.col("p_type").alias("cluster")))
    return p, genres, types, labels


_LABEL_SQL = f"""{_lift_sql('g', True, 8)}, {_lift_sql('t', False, 5)}, {_oi_sql('g', 0.08, 2)}, {_oi_sql('t', 0.15, 1)},
cl AS (SELECT DISTINCT p_type AS cluster FROM part),
bits AS (SELECT cl.cluster,
   list_concat(coalesce((SELECT list(value ORDER BY oi) FROM oi_g WHERE oi_g.cluster = cl.cluster), []),
               coalesce((SELECT list(value ORDER BY oi) FROM oi_t WHERE oi_t.cluster = cl.cluster), [])) AS b,
   list_concat(coalesce((SELECT list(value ORDER BY rk) FROM rec_g WHERE rec_g.cluster = cl.cluster AND rk <= 2), []),
               coalesce((SELECT list(value ORDER BY rk) FROM rec_t WHERE rec_t.cluster = cl.cluster AND rk <= 1), [])) AS fb
   FROM cl),
labels AS (SELECT cluster, CASE WHEN len(b) > 0 THEN array_to_string(b[1:4], ', ')
                     WHEN len(fb) > 0 THEN array_to_string(fb, ', ') ELSE 'cluster ' || cluster END AS interpretation_label
   FROM bits)"""


@register("interpretation_label", f"WITH {_LABEL_SQL} SELECT cluster, interpretation_label FROM labels")
def q_interpretation_label(spark, sf):
    return _part_profile_frames(spark, sf)[3]


@register("cluster_profile", _cluster_numeric_sql() + f""", {_LABEL_SQL},
z AS (SELECT cluster, c.col AS col, (mean - gm) / gs AS z FROM c JOIN g ON c.col = g.col WHERE n > 0),
zr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, col) AS rk FROM z),
tg AS (SELECT cluster, string_agg(value, ', ' ORDER BY rk) AS top_genres FROM rec_g WHERE rk <= 5 GROUP BY 1),
tt AS (SELECT cluster, string_agg(value, ', ' ORDER BY rk) AS top_types FROM rec_t WHERE rk <= 3 GROUP BY 1),
tz AS (SELECT cluster, string_agg(col, ', ' ORDER BY rk) AS top_numeric_features FROM zr WHERE rk <= 4 GROUP BY 1),
ts AS (SELECT cluster, share FROM rec_t WHERE rk = 1),
s AS (SELECT p_type AS cluster, count(*) AS size FROM part GROUP BY 1)
SELECT cluster, size, round(size / (SELECT count(*) FROM part), 6) + 0.0 AS proportion, top_genres, top_types,
  top_numeric_features, interpretation_label, round(coalesce(share, 0), 6) + 0.0 AS top_type_share,
  coalesce(share, 0) >= 0.8 AS format_artifact_warning
FROM s LEFT JOIN tg USING (cluster) LEFT JOIN tt USING (cluster) LEFT JOIN tz USING (cluster)
  LEFT JOIN ts USING (cluster) LEFT JOIN labels USING (cluster)
""")
def q_cluster_profile(spark, sf):
    p, genres, types, labels = _part_profile_frames(spark, sf)
    sizes = EV.cluster_sizes(p, "p_type")
    num = EV.cluster_numeric(part_input(spark, sf), "p_type", _PART_NUM)
    return rounded(EV.cluster_profile(sizes, genres, types, EV.top_z_features(num, 4), labels).drop("top_source_share"))


# ---------------------------------------------------------------- B5: metrics on embeddings (cluster = label)
from clusterlens.operators import metrics as M  # noqa: E402
from clusterlens.functions.vectors import lit_vector, sq_dist  # noqa: E402

_EMB_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_CENT_SQL = """u AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2),
cv AS (SELECT c.label, list(m ORDER BY i) AS cx, any_value(n) AS n FROM c
       JOIN (SELECT label, count(*) AS n FROM e GROUP BY 1) nn ON nn.label = c.label GROUP BY 1)"""


def emb(spark, sf):
    return tbl(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@register("silhouette", f"""
WITH {_EMB_SQL},
per AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.x, b.x) ^ 2) AS s
        FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
cnt AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
ab AS (SELECT p.vec_id, max(CASE WHEN p.lb = p.la THEN p.s / (c.n - 1) END) AS a,
              min(CASE WHEN p.lb <> p.la THEN p.s / c.n END) AS b
       FROM per p JOIN cnt c ON c.label = p.lb GROUP BY p.vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette,
       count(*) AS "rows" FROM ab
""")
def q_silhouette(spark, sf):
    """M-9 over all rows, with squared distances; the twin joins all pairs."""
    return rounded(M.silhouette(emb(spark, sf), "x", "label"))


@register("validate_dirty", """
WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN chr(9) ELSE source END AS source,
                  CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN' ELSE CAST(n_chars AS VARCHAR) END AS n, doc_id FROM documents),
f AS (SELECT trim(source, chr(9) || ' ') = '' AS m, coalesce(NOT (TRY_CAST(n AS DOUBLE) BETWEEN 100 AND 5000), false)
             OR coalesce(TRY_CAST(n AS DOUBLE) <= 0, false) AS i FROM d)
SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS missing_doc_id, count(*) FILTER (WHERE m) AS missing_source,
       count(*) FILTER (WHERE i) AS invalid_n, CAST(0 AS BIGINT) AS duplicate_doc_id,
       count(*) FILTER (WHERE m OR i) AS rejected_rows, count(*) FILTER (WHERE m OR i) AS warning_rows FROM f
""")
def q_validate_dirty(spark, sf):
    """V-1..V-10 strict on values that are no numbers, names of tabs only, and one column under two rules."""
    d = tbl(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "\t").otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 5 == 0, "UNKNOWN").otherwise(F.col("n_chars").cast("string")).alias("n"))
    report, _ = V.validate(d, key="doc_id", name="source", ranges={"n": (100, 5000)}, positive=["n"], strict=True)
    return report


@register("davies_bouldin", f"""
WITH {_EMB_SQL}, {_CENT_SQL},
s AS (SELECT e.label, avg(list_distance(e.x, cv.cx)) AS s FROM e JOIN cv ON e.label = cv.label GROUP BY 1),
r AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.cx, b.cx)) AS r FROM cv a JOIN cv b ON a.label <> b.label
      JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1)
SELECT round(avg(r), 6) + 0.0 AS davies_bouldin FROM r
""")
def q_davies_bouldin(spark, sf):
    return rounded(M.davies_bouldin(emb(spark, sf), "x", "label"))


@register("calinski_harabasz", f"""
WITH {_EMB_SQL}, {_CENT_SQL},
g AS (SELECT list(m ORDER BY i) AS gx FROM (SELECT i, avg(v) AS m FROM u GROUP BY 1)),
bw AS (SELECT sum(n * list_distance(cx, gx) ^ 2) AS between_ss, count(*) AS k, sum(n) AS n FROM cv, g),
ww AS (SELECT sum(list_distance(e.x, cv.cx) ^ 2) AS within_ss FROM e JOIN cv ON e.label = cv.label)
SELECT round(CASE WHEN within_ss = 0 THEN 1.0 ELSE between_ss * (n - k) / (within_ss * (k - 1)) END, 4) + 0.0
  AS calinski_harabasz FROM bw, ww
""")
def q_calinski_harabasz(spark, sf):
    return rounded(M.calinski_harabasz(emb(spark, sf), "x", "label"), 4)


def _fixed_centres(spark, sf):
    """Centre per label = embedding of its lowest vec_id (k rows, collected)."""
    e = emb(spark, sf)
    rows = e.groupBy("label").agg(F.min_by("x", "vec_id").alias("c")).orderBy("label").collect()
    return [r["label"] for r in rows], [list(r["c"]) for r in rows]


def nearest_centre(vec_col, centres, labels=None):
    """Index (or label) of the nearest centre; centres are a bounded literal list; ties -> first."""
    d = F.array(*[sq_dist(vec_col, lit_vector(c)) for c in centres])
    idx = (F.array_position(d, F.array_min(d)) - 1).cast("int")
    if labels is None:
        return idx
    return F.element_at(F.array(*[F.lit(v) for v in labels]), idx + 1)


_NEAREST_SQL = """fc AS (SELECT label AS cl, x AS cx FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn
                                                    FROM e) WHERE rn = 1),
nn AS (SELECT vec_id, label, cl AS pred FROM (SELECT e.vec_id, e.label, fc.cl,
         row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.x, fc.cx), fc.cl) AS r FROM e, fc) WHERE r = 1)"""


def _ari_nmi_sql(which):
    return f"""WITH {_EMB_SQL}, {_NEAREST_SQL},
ct AS (SELECT label AS a, pred AS b, CAST(count(*) AS DOUBLE) AS nij FROM nn GROUP BY 1, 2),
ra AS (SELECT a, sum(nij) AS na FROM ct GROUP BY 1), rb AS (SELECT b, sum(nij) AS nb FROM ct GROUP BY 1),
t AS (SELECT (SELECT sum(nij) FROM ct) AS n, (SELECT sum(nij * nij) FROM ct) AS ssq,
             (SELECT sum(na * na) FROM ra) AS sa2, (SELECT sum(nb * nb) FROM rb) AS sb2,
             (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb),
q AS (SELECT *, ssq - n AS tp, sb2 - ssq AS fp, sa2 - ssq AS fn, n * n - (sb2 - ssq) - (sa2 - ssq) - ssq AS tn FROM t),
mi AS (SELECT sum(nij / t.n * ln(nij * t.n / (na * nb))) AS mi FROM ct JOIN ra USING (a) JOIN rb USING (b), t),
h AS (SELECT (SELECT -sum(na / t.n * ln(na / t.n)) FROM ra, t) AS ha, (SELECT -sum(nb / t.n * ln(nb / t.n)) FROM rb, t) AS hb)
SELECT round(CASE WHEN fn = 0 AND fp = 0 THEN 1.0
                  ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 6) + 0.0 AS ari,
       round(CASE WHEN ka = 1 AND kb = 1 THEN 1.0 WHEN abs(mi) < 2.220446049250313e-16 THEN 0.0
                  ELSE mi / ((ha + hb) / 2) END, 6) + 0.0 AS nmi
FROM q, mi, h"""


@register("ari_nmi", _ari_nmi_sql("both"))
def q_ari_nmi(spark, sf):
    labels, centres = _fixed_centres(spark, sf)
    e = emb(spark, sf)
    e = e.withColumn("pred", nearest_centre(F.col("x"), centres, labels))
    return rounded(M.ari_nmi(e, "label", "pred"))


@register("close_means", f"""
WITH {_EMB_SQL}, {_CENT_SQL}
SELECT a.label AS cluster_a, b.label AS cluster_b, round(list_distance(a.cx, b.cx), 6) + 0.0 AS distance,
       list_distance(a.cx, b.cx) < 0.5 AS "close"
FROM cv a JOIN cv b ON a.label < b.label
""")
def q_close_means(spark, sf):
    return rounded(M.close_means(emb(spark, sf), "x", "label", 0.5))


# ---------------------------------------------------------------- B6/B7: K-means, GMM, PCA on embeddings
from clusterlens.operators import mixture as MX  # noqa: E402
from clusterlens.operators import pca as PCA  # noqa: E402
from clusterlens.operators import select as SEL  # noqa: E402


def _lloyd_sql_step(t):
    return f"""a{t} AS (SELECT vec_id, x, cl FROM (SELECT e.vec_id, e.x, c.cl,
       row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.x, c.cx), c.cl) AS r FROM e, c{t} c) WHERE r = 1),
m{t} AS (SELECT cl, list(m ORDER BY i) AS cx FROM (SELECT cl, i, avg(v) AS m FROM
       (SELECT cl, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{t}) GROUP BY 1, 2) GROUP BY 1),
c{t + 1} AS (SELECT cl, cx FROM m{t} UNION ALL SELECT cl, cx FROM c{t} WHERE cl NOT IN (SELECT cl FROM m{t}))"""


@register("kmeans_fixed_start", f"""
WITH {_EMB_SQL},
c0 AS (SELECT label AS cl, x AS cx FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM e)
       WHERE rn = 1),
{_lloyd_sql_step(0)}, {_lloyd_sql_step(1)}, {_lloyd_sql_step(2)},
fin AS (SELECT vec_id, cl, d FROM (SELECT e.vec_id, c.cl, list_distance(e.x, c.cx) AS d,
       row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.x, c.cx), c.cl) AS r FROM e, c3 c) WHERE r = 1)
SELECT CAST(c3.cl AS INTEGER) AS cluster, count(fin.vec_id) AS size,
       round(list_sum(c3.cx), 6) + 0.0 AS centre_sum, round((SELECT sum(d * d) FROM fin), 4) + 0.0 AS inertia
FROM c3 LEFT JOIN fin ON fin.cl = c3.cl GROUP BY c3.cl, c3.cx
""")
def q_kmeans_fixed_start(spark, sf):
    labels, centres = _fixed_centres(spark, sf)
    with MX.Matrix.of(emb(spark, sf), "x", "vec_id") as m:
        f = MX.kmeans_many(m, {0: MX.KMeansFit(len(centres), seed=0)}, max_iter=3, tol=-1.0, init_centres={0: np.asarray(centres)})[0]
        C = f.centres + m.shift
    rows = [(int(labels[j]), int(f.sizes[j]), float(C[j].sum()), float(f.inertia)) for j in range(len(C))]
    out = spark.createDataFrame(rows, "cluster int, size long, centre_sum double, inertia double")
    return rounded(out.select("cluster", "size", F.round("centre_sum", 6).alias("centre_sum"),
                              F.round("inertia", 4).alias("inertia")))


@register("kmeans_converged", f"""
WITH RECURSIVE {_EMB_SQL},
c0 AS (SELECT label AS cl, x AS cx FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM e)
       WHERE rn = 1),
it(t, cl, cx) AS (
  SELECT 0, cl, cx FROM c0
  UNION ALL
  SELECT t + 1, cl, list(m ORDER BY i) FROM (
    SELECT t, cl, i, avg(v) AS m FROM (
      SELECT t, cl, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (
        SELECT it.t, e.vec_id, any_value(e.x) AS x, arg_min(it.cl, list_distance(e.x, it.cx)) AS cl FROM e, it WHERE it.t < 60
        GROUP BY it.t, e.vec_id)) GROUP BY t, cl, i) GROUP BY t, cl),
last AS (SELECT cl, cx FROM it WHERE t = 60),
fin AS (SELECT e.vec_id, arg_min(l.cl, list_distance(e.x, l.cx)) AS cl, min(list_distance(e.x, l.cx)) AS d FROM e, last l GROUP BY e.vec_id)
SELECT CAST(last.cl AS INTEGER) AS cluster, count(fin.vec_id) AS size, round(list_sum(last.cx), 6) + 0.0 AS centre_sum,
       round((SELECT sum(d * d) FROM fin), 4) + 0.0 AS inertia
FROM last LEFT JOIN fin ON fin.cl = last.cl GROUP BY last.cl, last.cx
""")
def q_kmeans_converged(spark, sf):
    """M-8: Lloyd steps until no centre moves, from one row of each label."""
    labels, centres = _fixed_centres(spark, sf)
    with MX.Matrix.of(emb(spark, sf), "x", "vec_id") as m:
        f = MX.kmeans_many(m, {0: MX.KMeansFit(len(centres), seed=0)}, max_iter=60, tol=0.0, init_centres={0: np.asarray(centres)})[0]
        C = f.centres + m.shift
    rows = [(int(labels[j]), int(f.sizes[j]), float(C[j].sum()), float(f.inertia)) for j in range(len(C))]
    out = spark.createDataFrame(rows, "cluster int, size long, centre_sum double, inertia double")
    return out.select("cluster", "size", (F.round("centre_sum", 6) + F.lit(0.0)).alias("centre_sum"),
                      (F.round("inertia", 4) + F.lit(0.0)).alias("inertia"))


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    """M-8 / M-14: k-means|| seeding, then Lloyd (k = 10); per-cluster size with empty clusters kept."""
    e = emb(spark, sf)
    with MX.Matrix.of(e, "x", "vec_id") as m:
        fits = MX.kmeans_many(m, {0: MX.KMeansFit(10, seed=42)}, max_iter=300, tol=1e-4)
        model = {"kind": "kmeans", "centres": fits[0].centres + m.shift}
    return rounded(EV_sizes(MX.assign(e, "x", "vec_id", model), 10))


def EV_sizes(assigned, k):
    from clusterlens.operators.evaluate import cluster_sizes
    return cluster_sizes(assigned, "cluster", k)


def _label_gmm(spark, sf):
    """Diagonal GMM whose parameters are the label groups (weights = shares, means, population
    variances + 1e-6); k x d statistics from one partial aggregate."""
    e = emb(spark, sf)
    stats = M.centroids(e, "x", "label").collect()
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    var = {r["label"]: (np.asarray(r["v"].toArray()), r["n"]) for r in
           e.groupBy("label").agg(Summarizer.variance(array_to_vector("x")).alias("v"),
                                  F.count(F.lit(1)).alias("n")).collect()}
    stats = sorted(stats, key=lambda r: r["cluster"])
    n = sum(r["n"] for r in stats)
    weights = np.array([r["n"] / n for r in stats])
    means = np.array([r["centroid"] for r in stats])
    covs = np.array([var[r["cluster"]][0] * (r["n"] - 1) / r["n"] + 1e-6 for r in stats])
    return e, {"kind": "gmm", "weights": weights, "means": means, "covs": covs, "cov_type": "diag"}


_ESTEP_SQL = f"""{_EMB_SQL},
u AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
p AS (SELECT label, i, avg(v) AS mu, var_pop(v) + 1e-6 AS var FROM u GROUP BY 1, 2),
w AS (SELECT label, count(*) / (SELECT count(*) FROM e) AS w FROM e GROUP BY 1),
lp AS (SELECT u.vec_id, p.label AS k, -0.5 * sum(ln(2 * pi()) + ln(p.var) + (u.v - p.mu) ^ 2 / p.var) AS lg
       FROM u JOIN p ON u.i = p.i GROUP BY 1, 2),
lw AS (SELECT vec_id, k, lg + ln(w.w) AS a FROM lp JOIN w ON w.label = lp.k),
mx AS (SELECT vec_id, max(a) AS mx FROM lw GROUP BY 1),
lse AS (SELECT lw.vec_id, any_value(mx.mx) + ln(sum(exp(a - mx.mx))) AS lse FROM lw JOIN mx USING (vec_id) GROUP BY 1),
r AS (SELECT lw.vec_id, lw.k, exp(a - lse.lse) AS p FROM lw JOIN lse USING (vec_id)),
asg AS (SELECT vec_id, CAST(arg_max(k, p) AS INTEGER) AS cluster, max(p) AS max_probability,
        -sum(p * ln(p + 1e-12)) AS assignment_entropy FROM r GROUP BY 1)"""


@register("gmm_assignments", f"""WITH {_ESTEP_SQL}
SELECT vec_id, cluster, round(max_probability, 6) + 0.0 AS max_probability,
       round(assignment_entropy, 6) + 0.0 AS assignment_entropy FROM asg
""")
def q_gmm_assignments(spark, sf):
    e, model = _label_gmm(spark, sf)
    a = MX.assign(e, "x", "vec_id", model)
    return rounded(a.select("vec_id", "cluster", "max_probability", "assignment_entropy"))


@register("bic_aic", f"""WITH {_ESTEP_SQL}
SELECT round(avg(lse), 4) + 0.0 AS log_likelihood,
       round(-2 * avg(lse) * count(*) + (SELECT 2 * 10 * 64 + 10 - 1) * ln(count(*)), 2) + 0.0 AS bic,
       round(-2 * avg(lse) * count(*) + 2 * (SELECT 2 * 10 * 64 + 10 - 1), 2) + 0.0 AS aic,
       CAST(2 * 10 * 64 + 10 - 1 AS BIGINT) AS n_parameters FROM lse
""")
def q_bic_aic(spark, sf):
    e, model = _label_gmm(spark, sf)
    ll = MX.assign(e, "x", "vec_id", model).agg(F.avg("log_density").alias("ll"), F.count(F.lit(1)).alias("n")).first()
    k, d = len(model["weights"]), len(model["means"][0])
    bic, aic = MX.bic_aic(ll["ll"], ll["n"], k, d, "diag")
    row = (round(ll["ll"], 4) + 0.0, round(bic, 2) + 0.0, round(aic, 2) + 0.0, MX.n_parameters(k, d, "diag"))
    return spark.createDataFrame([row], "log_likelihood double, bic double, aic double, n_parameters long")


def _em_step_sql(cov_type):
    """One EM step on the first two dimensions, from the labels' shares, means and (co)variances."""
    a, b, c = ("var_pop(x1) + 1e-6", "covar_pop(x1, x2)" if cov_type == "full" else "0.0", "var_pop(x2) + 1e-6")
    return f"""
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings),
p AS (SELECT label AS k, count(*) / (SELECT count(*) FROM e) AS w, avg(x1) AS m1, avg(x2) AS m2, {a} AS a, {b} AS b, {c} AS c
      FROM e GROUP BY label),
lp AS (SELECT vec_id, x1, x2, k, ln(w) - ln(2 * pi()) - 0.5 * ln(a * c - b * b)
         - 0.5 * (c * (x1 - m1) ^ 2 - 2 * b * (x1 - m1) * (x2 - m2) + a * (x2 - m2) ^ 2) / (a * c - b * b) AS lp FROM e, p),
l AS (SELECT vec_id, max(lp) + ln(sum(exp(lp - mx))) AS lse FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS mx FROM lp) GROUP BY vec_id),
r AS (SELECT lp.*, exp(lp - lse) AS r FROM lp JOIN l USING (vec_id)),
m AS (SELECT k, sum(r) AS nk, sum(r * x1) / sum(r) AS n1, sum(r * x2) / sum(r) AS n2 FROM r GROUP BY k)
SELECT CAST(dense_rank() OVER (ORDER BY m.k) - 1 AS INTEGER) AS component, round(any_value(nk) / (SELECT count(*) FROM e), 6) + 0.0 AS weight,
  round(any_value(n1), 6) + 0.0 AS mean_1, round(any_value(n2), 6) + 0.0 AS mean_2,
  round(sum(r * (x1 - n1) ^ 2) / any_value(nk) + 1e-6, 6) + 0.0 AS cov_11,
  round({"sum(r * (x1 - n1) * (x2 - n2)) / any_value(nk)" if cov_type == "full" else "0.0::DOUBLE"}, 6) + 0.0 AS cov_12,
  round(sum(r * (x2 - n2) ^ 2) / any_value(nk) + 1e-6, 6) + 0.0 AS cov_22,
  round((SELECT avg(lse) FROM l), 6) + 0.0 AS lower_bound
FROM r JOIN m USING (k) GROUP BY m.k"""


def _em_step(spark, sf, cov_type):
    """M-5: one EM step of the engine from given parameters, components in the order of their labels."""
    e = tbl(spark, sf, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("x"))
    x1, x2 = F.col("x")[0], F.col("x")[1]
    start = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("a"),
                                   F.covar_pop(x1, x2).alias("b"), F.var_pop(x2).alias("c")).orderBy("label").collect()
    with MX.Matrix.of(e, "x", "vec_id") as m:
        f = MX.GMMFit(len(start), cov_type, seed=0)
        f.weights = np.array([r["n"] / m.n for r in start])
        f.means = np.array([[r["m1"], r["m2"]] for r in start]) - m.shift
        full = np.array([[[r["a"] + 1e-6, r["b"]], [r["b"], r["c"] + 1e-6]] for r in start])
        f.covs = full if cov_type == "full" else full[:, [0, 1], [0, 1]]
        MX.gmm_many(m, {0: f}, max_iter=1, tol=0.0)
        means = f.means + m.shift
    rows = []
    for j in range(f.k):
        c = f.covs[j] if cov_type == "full" else np.diag(f.covs[j])
        rows.append((j, float(f.weights[j]), *map(float, means[j]), float(c[0, 0]), float(c[0, 1]), float(c[1, 1]), float(f.lower_bound)))
    return rounded(spark.createDataFrame(rows, "component int, weight double, mean_1 double, mean_2 double, cov_11 double, cov_12 double, "
                                               "cov_22 double, lower_bound double"))


@register("em_step_diag", _em_step_sql("diag"))
def q_em_step_diag(spark, sf):
    return _em_step(spark, sf, "diag")


@register("em_step_full", _em_step_sql("full"))
def q_em_step_full(spark, sf):
    return _em_step(spark, sf, "full")


@register("representative_rows", f"""WITH {_ESTEP_SQL},
rr AS (SELECT 'representative' AS kind, cluster, vec_id,
       row_number() OVER (PARTITION BY cluster ORDER BY round(max_probability, 6) DESC, vec_id) AS rk FROM asg
       UNION ALL SELECT 'ambiguous', cluster, vec_id,
       row_number() OVER (PARTITION BY cluster ORDER BY round(assignment_entropy, 6) DESC, vec_id) FROM asg)
SELECT kind, cluster, vec_id, CAST(rk AS INTEGER) AS "rank" FROM rr WHERE rk <= 3
""")
def q_representative_rows(spark, sf):
    e, model = _label_gmm(spark, sf)
    a = rounded(MX.assign(e, "x", "vec_id", model).select("vec_id", "cluster", "max_probability",
                                                          "assignment_entropy")).persist()
    rep = EV.top_rows(a, "cluster", "max_probability", "vec_id", 3).select(F.lit("representative").alias("kind"),
                                                                          "cluster", "vec_id", "rank")
    amb = EV.top_rows(a, "cluster", "assignment_entropy", "vec_id", 3).select(F.lit("ambiguous").alias("kind"),
                                                                             "cluster", "vec_id", "rank")
    return settled(rep.unionByName(amb), a)


@register("assignment_summary", f"""WITH {_ESTEP_SQL}
SELECT round(avg(max_probability), 6) + 0.0 AS mean_max_responsibility,
       round(avg(assignment_entropy), 6) + 0.0 AS assignment_entropy_mean,
       round(max(assignment_entropy), 6) + 0.0 AS assignment_entropy_max,
       round(avg(CASE WHEN max_probability < 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS low_confidence_fraction,
       round(median(max_probability), 6) + 0.0 AS median_max_responsibility,
       round(median(assignment_entropy), 6) + 0.0 AS assignment_entropy_median FROM asg
""")
def q_assignment_summary(spark, sf):
    e, model = _label_gmm(spark, sf)
    return rounded(EV.assignment_summary(MX.assign(e, "x", "vec_id", model)))


@register("gmm_fit")
def q_gmm_fit(spark, sf):
    """M-5: diagonal and full GMM (k = 10, k-means init, tol 1e-3) in the same scans: weight, hard size, converged per component."""
    fits = {i: MX.GMMFit(10, c, seed=42) for i, c in enumerate(("diag", "full"))}
    with MX.Matrix.of(emb(spark, sf), "x", "vec_id") as m:
        MX.gmm_many(m, fits, max_iter=300, tol=1e-3)
    rows = [(f.cov_type, j, float(f.weights[j]), int(f.sizes[j]), bool(f.converged), int(f.n_iter)) for f in fits.values() for j in range(f.k)]
    return spark.createDataFrame(rows, "covariance_type string, component int, weight double, size long, converged boolean, n_iter int")


def _cov_sql():
    return f"""WITH {_EMB_SQL}, u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e)
SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov
FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i"""


@register("pca_covariance", _cov_sql())
def q_pca_covariance(spark, sf):
    with MX.Matrix.of(emb(spark, sf), "x", "vec_id") as m:
        cov = PCA.covariance(m)
    d = len(cov)
    rows = [(i, j, float(cov[i, j])) for i in range(d) for j in range(d)]
    return rounded(spark.createDataFrame(rows, "i int, j int, cov double"))


def _pca(spark, sf, target=0.9):
    e = emb(spark, sf)
    with MX.Matrix.of(e, "x", "vec_id") as m:
        model = PCA.fit(m, target)
    return e, model


@register("pca_fit")
def q_pca_fit(spark, sf):
    _, model = _pca(spark, sf)
    return rounded(PCA.component_table(spark, model))


@register("pca_transform")
def q_pca_transform(spark, sf):
    e, model = _pca(spark, sf)
    pc = PCA.transform(e, "x", "vec_id", model)
    return rounded(pc.select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2")))


@register("pca_energy", f"""WITH {_EMB_SQL}, u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
t AS (SELECT sum(s) AS total FROM (SELECT var_samp(v) AS s FROM u GROUP BY i))
SELECT solver, round(total, 6) + 0.0 AS total_variance, round(total, 6) + 0.0 AS score_variance, 0.0::DOUBLE AS mean_score
FROM t, (VALUES ('covariance_eigh'), ('randomized')) s(solver)
""")
def q_pca_energy(spark, sf):
    """M-1 / M-2: all components of either solver together hold all of the variance, and their scores have mean 0."""
    e = emb(spark, sf)
    out = None
    for solver in ("covariance_eigh", "randomized"):
        with MX.Matrix.of(e, "x", "vec_id") as m:
            model = PCA.fit(m, m.d, svd_solver=solver)
        pc = PCA.transform(e, "x", "vec_id", model).select("vec_id", F.posexplode("pc").alias("i", "v"))
        per = pc.groupBy("i").agg(F.var_samp("v").alias("s"), F.avg("v").alias("m"))
        row = per.agg(F.round(F.lit(float(model.explained_variance.sum())), 6).alias("total_variance"), F.round(F.sum("s"), 6).alias("score_variance"),
                      F.round(F.max(F.abs("m")), 6).alias("mean_score")).select(F.lit(solver).alias("solver"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@register("top_loadings")
def q_top_loadings(spark, sf):
    _, model = _pca(spark, sf)
    names = [f"dim_{i:02d}" for i in range(model.components.shape[1])]
    return rounded(PCA.top_loadings(PCA.loadings(spark, model, names), 10, 5))


#: Search settings: all of the configured grid but the number of starts, for which see the README.
KMEANS_GRID = {"candidate_k": range(2, 13), "seeds": SEL.seed_sequence(42, 5), "n_init": 2, "max_iter": 500}
GMM_GRID = {"candidate_k": range(2, 13), "cov_types": ("diag", "full"), "seeds": SEL.seed_sequence(42, 5), "n_init": 1, "max_iter": 300}


def _kmeans_search(spark, sf, **changes):
    with MX.Matrix.of(emb(spark, sf), "x", "vec_id") as m:
        return SEL.search(m, "kmeans", **{**KMEANS_GRID, **changes})


def _gmm_search(spark, sf, **changes):
    """On the first ten principal components (gmm_reduced)."""
    e = emb(spark, sf)
    with MX.Matrix.of(e, "x", "vec_id") as m:
        model = PCA.fit(m, 10)
    with MX.Matrix.of(PCA.transform(e, "x", "vec_id", model), "pc", "vec_id") as m:
        return SEL.search(m, "gmm", **{**GMM_GRID, **changes})


@register("select_model")
def q_select_model(spark, sf):
    """M-15..M-19: K-means search K 2..12 x 5 seeds with stability, guardrails and ranking."""
    return rounded(_kmeans_search(spark, sf)[0].select(
        "selection_rank", "k", "silhouette", "davies_bouldin", "inertia", "stability_ari_mean", "smallest_cluster_proportion",
        "selection_valid", "passes_stability_guardrail"))


@register("select_gmm")
def q_select_gmm(spark, sf):
    """GMM search over K 2..12 x {diag, full} x 5 seeds on the PCA-reduced embeddings (gmm_reduced)."""
    return rounded(_gmm_search(spark, sf)[0].select("selection_rank", "k", "covariance_type", "bic", "aic", "log_likelihood",
                                                    "stability_ari_mean", "selection_valid"))


# ---------------------------------------------------------------- flagship
def flagship_profile(spark, sf):
    """part (+ lineitem aggregates) -> features -> K-means -> cluster profile."""
    matrix, _, _ = _part_matrix(spark, sf)
    with MX.Matrix.of(matrix, "features", "p_partkey") as m:
        fit = MX.kmeans_many(m, {0: MX.KMeansFit(6, seed=42)}, max_iter=300, tol=1e-4)[0]
        model = {"kind": "kmeans", "centres": fit.centres + m.shift}
        # score the persisted matrix once; every profile aggregate below reuses the persisted assignment
        assigned = MX.assign(m.df, "x", "id", model).withColumnRenamed("id", "p_partkey").persist()
        held = part_input(spark, sf).join(assigned.select("p_partkey", "cluster"), "p_partkey").persist()
        held.count()
        meta = held.coalesce(m.parts)  # every aggregate below is a stage of as many tasks as the table has partitions
    genres = L.multilabel_lift(meta, "cluster", _words(), 8)
    types = L.category_lift(meta, "cluster", "p_type", 5)
    labels = EV.interpretation_labels(genres, types, None, meta.select("cluster"))
    num = EV.cluster_numeric(meta, "cluster", _PART_NUM)
    sizes = EV.cluster_sizes(assigned, "cluster", 6)
    names = EV.examples(assigned.select("p_partkey", "cluster", "max_probability", "assignment_entropy"), "cluster", "p_partkey")
    return settled(rounded(EV.cluster_profile(sizes, genres, types, EV.top_z_features(num, 4), labels, names=names)), held, assigned)


@register("flagship_profile")
def q_flagship_profile(spark, sf):
    return flagship_profile(spark, sf)


# ---------------------------------------------------------------- composed steps, diagnostics, chart tables
from clusterlens.operators import models as MOD  # noqa: E402
from clusterlens.plans import workflow as WF  # noqa: E402


def _cleaned_events(spark, sf):
    return C.clean(_events_tokenized(spark, sf), key="event_id", numeric=["value"], categorical=["event_type"],
                   order_col="event_id", keep="first")


@register("clean_table", f"""
SELECT event_id, user_id,
       CASE WHEN et IS NULL OR lower(trim(et)) IN ('unknown', '') THEN 'missing' ELSE lower(trim(et)) END AS event_type,
       value
FROM (SELECT event_id, user_id, {_EVT_TOKEN_SQL} AS et, value FROM events) WHERE event_id IS NOT NULL
""")
def q_clean_table(spark, sf):
    out, _ = _cleaned_events(spark, sf)
    return out.select("event_id", "user_id", "event_type", "value")


def _dirty_orders(spark, sf):
    """orders with repeated keys, missing tokens, gaps in the numbers and a key that is not there."""
    o = tbl(spark, sf, "orders")
    key = F.col("o_orderkey")
    x = o.select(F.when(key % 50 == 0, F.lit(None)).when(key % 10 == 1, key - 1).otherwise(key).alias("k"), key.alias("line"),
                 F.when(key % 6 == 0, F.lit(" Unknown ")).otherwise(F.col("o_orderpriority")).alias("priority"),
                 F.when(key % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"),
                 F.when(key % 9 == 0, F.lit("")).otherwise((key % 100).cast("string")).alias("units"))
    return C.clean(x, key="k", numeric=["price", "units"], categorical=["priority"], order_col="line", keep="first")


_DIRTY_SQL = """
o AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS k, o_orderkey AS line,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS units FROM orders),
keyed AS (SELECT * FROM o WHERE k IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY line) AS rn FROM keyed) WHERE rn = 1)"""


@register("clean_summary", f"""WITH {_DIRTY_SQL}
SELECT (SELECT count(*) FROM o) AS rows_in, (SELECT count(*) FROM one) AS rows_out, (SELECT count(*) FROM o) - (SELECT count(*) FROM one) AS rows_dropped,
  (SELECT count(*) FROM keyed) - (SELECT count(*) FROM one) AS duplicates_removed,
  (SELECT count(*) FROM o WHERE line % 6 = 0) AS priority_tokens, (SELECT count(*) FROM one WHERE price IS NULL OR units IS NULL) AS rows_imputed,
  CAST((SELECT (count(price) > 0)::INT + (count(units) > 0)::INT FROM one) AS BIGINT) AS imputed_columns,
  round((SELECT median(price) FROM one), 4) + 0.0 AS price_median, round((SELECT median(units) FROM one), 4) + 0.0 AS units_median
""")
def q_clean_summary(spark, sf):
    """A-12: every field of the cleaning summary."""
    _, s = _dirty_orders(spark, sf)
    row = (s["rows_in"], s["rows_out"], s["rows_dropped"], s["duplicates_removed"], s["tokens_replaced"]["priority"], s["rows_imputed"],
           len(s["imputed_columns"]), s["medians"]["price"], s["medians"]["units"])
    return rounded(spark.createDataFrame([row], "rows_in long, rows_out long, rows_dropped long, duplicates_removed long, priority_tokens long, "
                                                "rows_imputed long, imputed_columns long, price_median double, units_median double"), 4)


@register("validate_duration", f"""
WITH d AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'soon' WHEN event_id % 13 = 0 THEN '  ' ELSE {_DUR_SQL} END AS t FROM events),
f AS (SELECT t, TRY_CAST(nullif(regexp_extract(lower(trim(t)), '(\\d+)\\s*hr', 1), '') AS BIGINT) AS h,
      TRY_CAST(nullif(regexp_extract(lower(trim(t)), '(\\d+)\\s*min', 1), '') AS BIGINT) AS m FROM d)
SELECT count(*) AS "rows", count(*) FILTER (WHERE trim(t) = '') AS missing_t,
  count(*) FILTER (WHERE trim(t) <> '' AND coalesce(h, 0) * 60 + coalesce(m, 0) <= 0) AS invalid_t FROM f
""")
def q_validate_duration(spark, sf):
    """V-6: durations that are there but say nothing."""
    dur = F.expr(_DUR_SQL.replace("VARCHAR", "STRING"))
    e = tbl(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "soon").when(F.col("event_id") % 13 == 0, "  ")
                                        .otherwise(dur).alias("t"))
    return V.validate(e, key="event_id", name="t", duration_col="t")[0].select("rows", "missing_t", "invalid_t")


from clusterlens.sources import io as IO  # noqa: E402


@register("ingest_summary", """
SELECT column_name AS "column", upper(replace(column_name, '_', ' ')) AS original,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS dtype,
  (SELECT count(*) FROM customer) AS "rows" FROM duckdb_columns() WHERE table_name = 'customer'
""")
def q_ingest_summary(spark, sf):
    """S-9 / S-10 / A-9: a table with a foreign spelling of its header, checked, renamed and summarised."""
    c = tbl(spark, sf, "customer")
    raw = c.toDF(*[x.replace("_", " ").upper() for x in c.columns])
    df, mapping = IO.ingest(raw, required=["C CUSTKEY", "C NAME"])
    return IO.schema_summary(df, mapping)


@register("interpretation_slice", "SELECT p_partkey, p_name, p_type FROM part")
def q_interpretation_slice(spark, sf):
    """S-12: the columns that interpret a cluster, as far as the table has them."""
    return IO.select_present(tbl(spark, sf, "part"), ["p_partkey", "p_name", "absent", "p_type"])


@register("feature_gaps", _matrix_sql() + """
SELECT feature, CASE WHEN starts_with(feature, 'numeric__') THEN 'numeric' WHEN starts_with(feature, 'categorical__') THEN 'categorical' ELSE 'multi_hot' END
  AS family, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS nulls, count(*) FILTER (WHERE value = 0) AS zeros FROM longf GROUP BY feature""")
def q_feature_gaps(spark, sf):
    """A-19 / C-4: nulls and zeros of every feature with its family."""
    _, names, wide = _part_matrix(spark, sf)
    return FE.feature_gaps(wide, names)


def _conf_hist_sql():
    parts = [f"""SELECT '{c}' AS "column", {c} AS x, lo, hi FROM asg,
 (SELECT min({c}) AS lo, max({c}) AS hi FROM asg) s WHERE {c} IS NOT NULL""" for c in
             ["max_probability", "assignment_entropy"]]
    return (f"WITH {_ESTEP_SQL}, hu AS (" + " UNION ALL ".join(parts) + "), b AS (SELECT \"column\", lo, hi, "
            "CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 30), 29) ELSE 0 END AS INTEGER) AS bin FROM hu) "
            "SELECT \"column\", bin, round(lo + bin * ((hi - lo) / 30), 6) + 0.0 AS bin_start, "
            "round(lo + (bin + 1) * ((hi - lo) / 30), 6) + 0.0 AS bin_end, count(*) AS \"count\" "
            "FROM b GROUP BY \"column\", lo, hi, bin")


@register("confidence_histogram", _conf_hist_sql())
def q_confidence_histogram(spark, sf):
    """C-6: confidence and entropy histograms of the assignment table."""
    e, model = _label_gmm(spark, sf)
    a = MX.assign(e, "x", "vec_id", model).persist()
    return settled(rounded(P.histogram(a, ["max_probability", "assignment_entropy"], 30)), a)


_NAME_SQL = "CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 'vec-' || CAST(vec_id % 50 AS VARCHAR) END"


@register("metadata_join", f"""WITH {_ESTEP_SQL},
meta AS (SELECT vec_id, {_NAME_SQL} AS name, label FROM embeddings)
SELECT a.vec_id, a.name, a.cluster, m.label, round(a.max_probability, 6) + 0.0 AS max_probability
FROM (SELECT vec_id, {_NAME_SQL} AS name, cluster, max_probability FROM asg) a
LEFT JOIN meta m ON a.vec_id IS NOT DISTINCT FROM m.vec_id AND a.name IS NOT DISTINCT FROM m.name
""")
def q_metadata_join(spark, sf):
    """S-11 / J-1: rows keyed by a number and a text that may be NULL are scored and joined to their metadata, NULL-safe."""
    e, model = _label_gmm(spark, sf)
    name = F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("vec-"), (F.col("vec_id") % 50).cast("string"))).alias("name")
    keys = ["vec_id", "name"]
    a = MX.assign(e.select("vec_id", name, "x"), "x", keys, model).select(*keys, "cluster", "max_probability")
    j = WF.metadata_join(a, tbl(spark, sf, "embeddings").select("vec_id", name, "label"), keys)
    return rounded(j.select(*keys, "cluster", "label", "max_probability"))


@register("projection_2d")
def q_projection_2d(spark, sf):
    """M-4 / C-10: first two centred components with cluster and opacity = clip(max prob, 0.2, 1)."""
    e, model = _label_gmm(spark, sf)
    with MX.Matrix.of(e, "x", "vec_id") as m:
        p2 = PCA.fit(m, 2)
    pts = PCA.transform(e, "x", "vec_id", p2).select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
    a = MX.assign(e, "x", "vec_id", model).select("vec_id", "cluster", "max_probability")
    return rounded(pts.join(a, "vec_id").select(
        "vec_id", "pc1", "pc2", "cluster",
        F.least(F.greatest("max_probability", F.lit(0.2)), F.lit(1.0)).alias("opacity")))


@register("model_diagnostics")
def q_model_diagnostics(spark, sf):
    """M-22 / M-23: fitted diagonal GMM (k = 10, n_init 5) parameters and health checks."""
    e = emb(spark, sf)
    with MX.Matrix.of(e, "x", "vec_id") as m:
        model = MOD.get_adapter("gmm").fit(m, {**MOD.TRAINING["gmm"], "k": 10, "covariance_type": "diag"}, 42)
        return rounded(MOD.diagnostics(spark, model, m.n, m.d, assigned=MX.assign(e, "x", "vec_id", model)))


@register("model_parameters", f"""WITH {_ESTEP_SQL}
SELECT CAST(dense_rank() OVER (ORDER BY p.label) - 1 AS INTEGER) AS component, CAST(i - 1 AS INTEGER) AS dim,
  round(w.w, 6) + 0.0 AS weight, round(mu, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS variance
FROM p JOIN w ON p.label = w.label
""")
def q_model_parameters(spark, sf):
    """S-8 / M-22: the label GMM's parameter table, one row per component and dimension."""
    _, model = _label_gmm(spark, sf)
    each = F.posexplode(F.arrays_zip("mean", F.col("covariance").alias("variance"))).alias("dim", "p")
    return rounded(MOD.model_table(spark, model).select("component", "weight", each)
                   .select("component", "dim", "weight", "p.mean", "p.variance"))


@register("final_metrics", f"""WITH {_ESTEP_SQL},
f AS (SELECT e.vec_id, asg.cluster AS label, e.x FROM asg JOIN e USING (vec_id)),
fu AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM f),
fc AS (SELECT label, list(m ORDER BY i) AS cx, any_value(n) AS n FROM (SELECT label, i, avg(v) AS m, count(*) AS n FROM fu GROUP BY 1, 2) GROUP BY 1),
fg AS (SELECT list(m ORDER BY i) AS gx FROM (SELECT i, avg(v) AS m FROM fu GROUP BY 1)),
per AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.x, b.x) ^ 2) AS s
        FROM f a JOIN f b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ab AS (SELECT p.vec_id, max(CASE WHEN p.lb = p.la THEN p.s / (c.n - 1) END) AS a, min(CASE WHEN p.lb <> p.la THEN p.s / c.n END) AS b
       FROM per p JOIN fc c ON c.label = p.lb GROUP BY p.vec_id),
sp AS (SELECT f.label, avg(list_distance(f.x, fc.cx)) AS s, sum(list_distance(f.x, fc.cx) ^ 2) AS w FROM f JOIN fc USING (label) GROUP BY 1),
db AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.cx, b.cx)) AS r FROM fc a JOIN fc b ON a.label <> b.label
       JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label GROUP BY 1),
bw AS (SELECT sum(n * list_distance(cx, gx) ^ 2) AS b, count(*) AS k, sum(n) AS n FROM fc, fg),
sz AS (SELECT count(*) AS size FROM asg GROUP BY cluster)
SELECT 'bic' AS selection_metric_primary, 'aic' AS selection_metric_secondary, CAST(NULL AS VARCHAR) AS selection_metric_tertiary,
  (SELECT min(size) FROM sz) AS min_cluster_size, (SELECT max(size) FROM sz) AS max_cluster_size,
  round((SELECT avg(size) FROM sz), 6) + 0.0 AS mean_cluster_size,
  round((SELECT avg(max_probability) FROM asg), 6) + 0.0 AS mean_max_responsibility,
  round((SELECT median(max_probability) FROM asg), 6) + 0.0 AS median_max_responsibility,
  round((SELECT avg(assignment_entropy) FROM asg), 6) + 0.0 AS assignment_entropy_mean,
  round((SELECT median(assignment_entropy) FROM asg), 6) + 0.0 AS assignment_entropy_median,
  round((SELECT max(assignment_entropy) FROM asg), 6) + 0.0 AS assignment_entropy_max,
  round((SELECT avg(CASE WHEN max_probability < 0.5 THEN 1.0 ELSE 0.0 END) FROM asg), 6) + 0.0 AS low_confidence_fraction,
  round((SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) FROM ab), 6) + 0.0 AS silhouette,
  round((SELECT avg(r) FROM db), 6) + 0.0 AS davies_bouldin,
  round((SELECT b * (n - k) / ((SELECT sum(w) FROM sp) * (k - 1)) FROM bw), 6) + 0.0 AS calinski_harabasz,
  round((SELECT -2 * avg(lse) * count(*) + (2 * 10 * 64 + 10 - 1) * ln(count(*)) FROM lse), 6) + 0.0 AS bic,
  round((SELECT -2 * avg(lse) * count(*) + 2 * (2 * 10 * 64 + 10 - 1) FROM lse), 6) + 0.0 AS aic,
  round((SELECT avg(lse) FROM lse), 6) + 0.0 AS average_log_likelihood
""")
def q_final_metrics(spark, sf):
    """P-7: size and confidence statistics, silhouette, Davies-Bouldin, Calinski-Harabasz, BIC, AIC and likelihood of the label GMM."""
    e, model = _label_gmm(spark, sf)
    a = MX.assign(e, "x", "vec_id", model)
    ll = a.agg(F.avg("log_density").alias("ll"), F.count(F.lit(1)).alias("n")).first()
    k, d = len(model["weights"]), len(model["means"][0])
    bic, aic = MX.bic_aic(ll["ll"], ll["n"], k, d, "diag")
    best = {"bic": bic, "aic": aic, "log_likelihood": ll["ll"]}
    out = WF.final_metrics(a, e, "vec_id", "x", best=best, scoring=SEL.GMM_SCORING).drop("cluster_size_distribution")
    return rounded(out)


@register("distribution_report")
def q_distribution_report(spark, sf):
    """P-6: nested (cluster -> genres / type records) report over part clustered by p_type."""
    p = tbl(spark, sf, "part").withColumn("cluster", F.col("p_type"))
    rep = WF.distribution_report(p, _words(), ["p_brand"], type_col="p_brand")
    return rep.select("cluster", F.size("genres").alias("n_genre_records"), F.size("p_brand").alias("n_type_records"),
                      F.to_json("genres").alias("genres_json"))


@register("distribution_report_records", f"""
WITH {_lift_sql('g', True, 8)}, {_lift_sql('t', False, 5)}
SELECT 'genres' AS section, cluster, value, cnt AS "count", round(share, 6) + 0.0 AS cluster_share,
  round(lift, 6) + 0.0 AS lift_vs_global, CAST(rk AS INTEGER) AS "rank" FROM rec_g
UNION ALL SELECT 'p_brand', cluster, value, cnt, round(share, 6) + 0.0, round(lift, 6) + 0.0, CAST(rk AS INTEGER)
FROM rec_t
""")
def q_distribution_report_records(spark, sf):
    """P-6: the records of the nested report, taken out of it again."""
    p = tbl(spark, sf, "part").withColumn("cluster", F.col("p_type"))
    rep = WF.distribution_report(p, _words(), ["p_brand"])
    parts = [rep.select(F.lit(n).alias("section"), "cluster", F.inline(n)) for n in ("genres", "p_brand")]
    return rounded(parts[0].unionByName(parts[1]).drop("global_share"))


@register("model_stage_reduced")
def q_model_stage_reduced(spark, sf):
    """End to end on the PCA-reduced embeddings: K-means search, final fit, assign."""
    e = emb(spark, sf)
    red, _ = WF.reduce_matrix(e.withColumnRenamed("x", "features"), "vec_id", 0.9)
    res = WF.model_stage(red, "vec_id", "kmeans_reduced", features="pc", candidate_k=KMEANS_GRID["candidate_k"], seeds=KMEANS_GRID["seeds"],
                         search_kw={"n_init": 1})
    return rounded(EV.cluster_sizes(res["assignments"], "cluster", res["model"]["k"]))


@register("share_dominance", f"""
WITH {_lift_sql('t', False, 5)}
SELECT round(avg(share), 6) + 0.0 AS mean_top_share, count(*) FILTER (WHERE share >= 0.8) AS dominated_clusters
FROM rec_t WHERE rk = 1
""")
def q_share_dominance(spark, sf):
    """A-31 / P-4: dominance of the top p_brand per p_type cluster."""
    types = L.category_lift(tbl(spark, sf, "part"), "p_type", "p_brand", 5)
    return rounded(EV.share_dominance(types))


@register("metric_curve")
def q_metric_curve(spark, sf):
    """K-6 / C-5: the metrics of both families by K, in long form (family, covariance_type, k, metric, value)."""
    def long(ranked, family, metrics):
        items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])
        return ranked.select(F.lit(family).alias("family"), "covariance_type", "k", F.inline(items))
    kmeans = _kmeans_search(spark, sf)[0]
    gmm = _gmm_search(spark, sf)[0]
    return rounded(long(kmeans, "kmeans", ["inertia", "silhouette", "davies_bouldin", "calinski_harabasz"]).unionByName(
        long(gmm, "gmm", ["bic", "aic", "log_likelihood"])))


@register("selection_warnings")
def q_selection_warnings(spark, sf):
    """M-18: degenerate / imbalance / low-stability warnings of the K-means search."""
    return rounded(_kmeans_search(spark, sf)[2])


@register("training_summary")
def q_training_summary(spark, sf):
    """M-20 / M-24: final K-means fit with parameter precedence (training <- best <- override) and its record."""
    params = SEL.final_params({"k": 10}, MOD.TRAINING["kmeans"], {"tol": 1e-5})
    with MX.Matrix.of(emb(spark, sf), "x", "vec_id") as m:
        model = MOD.get_adapter("kmeans_reduced").fit(m, params, 42)
        return rounded(MOD.training_summary(spark, model, params, m.n, m.d, run_id="embeddings-kmeans"), 4)


# ---------------------------------------------------------------- stages over column roles
from clusterlens.plans import stages as ST  # noqa: E402

_PART_ROLES = ST.Roles(ids=("p_partkey",), numeric=("p_size", "p_retailprice", "n_lines", "qty_sum", "avg_discount", "absent"),
                       categorical=("p_type", "p_brand"), multi_label=("p_name",), log=("n_lines", "qty_sum"))


@register("transform_matrix", _matrix_sql("lower(trim({}))") + """
SELECT p_partkey, feature, round(value, 6) + 0.0 AS value FROM longf""")
def q_transform_matrix(spark, sf):
    """F-15 / F-16: raw part columns by their roles -> transformed table -> feature matrix."""
    li = tbl(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty_sum"),
                                                             F.avg("l_discount").alias("avg_discount"))
    p = tbl(spark, sf, "part").withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("|")))
    raw = p.join(li, p["p_partkey"] == li["l_partkey"], "left").drop("l_partkey")
    out, _ = ST.transform(raw, _PART_ROLES)
    _, names, wide = ST.feature_matrix(out, _PART_ROLES)
    return rounded(FE.unpivot_features(wide, ["p_partkey"], names))


_SOURCE_SQL = "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'size ' || CAST(p_size // 10 AS VARCHAR) END"
_EVAL_SQL = f"""{_cluster_numeric_sql()}, {_lift_sql('g', True, 8)}, {_lift_sql('t', False, 5)}, {_lift_sql('s', False, 5, _SOURCE_SQL)},
{_oi_sql('g', 0.08, 2)}, {_oi_sql('t', 0.15, 1)}, {_oi_sql('s', 0.12, 1)},
cl AS (SELECT p_type AS cluster, count(*) AS size, count(*) / (SELECT count(*) FROM part) AS proportion FROM part GROUP BY 1),
bits AS (SELECT cl.cluster, list_concat(list_concat(
   coalesce((SELECT list(value ORDER BY oi) FROM oi_g WHERE oi_g.cluster = cl.cluster), []),
   coalesce((SELECT list(value ORDER BY oi) FROM oi_t WHERE oi_t.cluster = cl.cluster), [])),
   coalesce((SELECT list(value ORDER BY oi) FROM oi_s WHERE oi_s.cluster = cl.cluster), [])) AS b,
   list_concat(coalesce((SELECT list(value ORDER BY rk) FROM rec_g WHERE rec_g.cluster = cl.cluster AND rk <= 2), []),
               coalesce((SELECT list(value ORDER BY rk) FROM rec_t WHERE rec_t.cluster = cl.cluster AND rk <= 1), [])) AS fb FROM cl),
labels AS (SELECT cluster, CASE WHEN len(b) > 0 THEN array_to_string(b[1:4], ', ') WHEN len(fb) > 0 THEN array_to_string(fb, ', ')
           ELSE 'cluster ' || cluster END AS interpretation_label FROM bits),
z AS (SELECT cluster, c.col AS col, (mean - gm) / gs AS z FROM c JOIN g ON c.col = g.col WHERE n > 0),
zr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, col) AS rk FROM z),
ex AS (SELECT p_type AS cluster, p_name || ' #' || p_partkey AS name,
  row_number() OVER (PARTITION BY p_type ORDER BY p_partkey % 97 DESC, p_name || ' #' || p_partkey) AS r,
  row_number() OVER (PARTITION BY p_type ORDER BY p_partkey % 89 DESC, p_name || ' #' || p_partkey) AS a FROM part),
rep AS (SELECT cluster, string_agg(name, ', ' ORDER BY r) FILTER (r <= 3) AS representative,
  string_agg(name, ', ' ORDER BY a) FILTER (a <= 3) AS ambiguous FROM ex GROUP BY 1),
tg AS (SELECT cluster, string_agg(value, ', ' ORDER BY rk) AS top_genres FROM rec_g WHERE rk <= 5 GROUP BY 1),
tt AS (SELECT cluster, string_agg(value, ', ' ORDER BY rk) AS top_types FROM rec_t WHERE rk <= 3 GROUP BY 1),
tz AS (SELECT cluster, string_agg(col, ', ' ORDER BY rk) AS top_numeric_features FROM zr WHERE rk <= 4 GROUP BY 1),
sh AS (SELECT t.cluster, t.share AS top_type_share, s.share AS top_source_share FROM rec_t t LEFT JOIN rec_s s ON s.cluster = t.cluster AND s.rk = 1
       WHERE t.rk = 1)"""


def _evaluated(spark, sf):
    """part clustered by its type, with stand-ins for confidence and entropy that follow from the key."""
    p = part_input(spark, sf)
    key = F.col("p_partkey")
    assigned = p.select(key, F.col("p_type").alias("cluster"), ((key % 97) / 97).alias("max_probability"), ((key % 89) / 89).alias("assignment_entropy"))
    meta = p.select(key, F.concat("p_name", F.lit(" #"), key).alias("title"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("p_name"), "p_brand",
                    F.when(key % 10 != 0, F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string"))).alias("size_class"), *_PART_NUM)
    roles = ST.Roles(ids=("p_partkey",), numeric=tuple(_PART_NUM), categorical=("p_brand", "size_class"), multi_label=("p_name",))
    return ST.evaluate(assigned, meta, roles, name_col="title")


@register("evaluate_profile", _EVAL_SQL + """
SELECT cluster, size, round(proportion, 6) + 0.0 AS proportion, top_genres, top_types, top_numeric_features, interpretation_label,
  representative, ambiguous, round(top_type_share, 6) + 0.0 AS top_type_share, round(top_source_share, 6) + 0.0 AS top_source_share,
  top_type_share >= 0.8 OR top_source_share >= 0.8 AS format_artifact_warning
FROM cl JOIN tg USING (cluster) JOIN tt USING (cluster) JOIN tz USING (cluster) JOIN labels USING (cluster) JOIN rep USING (cluster) JOIN sh USING (cluster)
""")
def q_evaluate_profile(spark, sf):
    """P-4 / P-5: the whole profile: examples, label from tags, types and sources, both dominance shares."""
    return rounded(_evaluated(spark, sf)["profile"])


@register("evaluate_report", _EVAL_SQL + """
SELECT cl.cluster, size, round(proportion, 6) + 0.0 AS proportion, interpretation_label, representative, ambiguous,
  round(top_type_share, 6) + 0.0 AS top_type_share, round(top_source_share, 6) + 0.0 AS top_source_share,
  (SELECT count(*) FROM rec_g r WHERE r.cluster = cl.cluster) AS n_genres, (SELECT count(*) FROM rec_t r WHERE r.cluster = cl.cluster) AS n_types,
  (SELECT count(*) FROM rec_s r WHERE r.cluster = cl.cluster) AS n_sources, top_numeric_features, c.col AS "column", c.n AS n,
  round(c.mean, 4) + 0.0 AS mean, round(c.median, 4) + 0.0 AS median, round(c.std, 4) + 0.0 AS std, round(z.z, 4) + 0.0 AS z_score_vs_global
FROM cl JOIN labels USING (cluster) JOIN rep USING (cluster) JOIN sh USING (cluster) JOIN tz USING (cluster)
JOIN c ON c.cluster = cl.cluster AND c.n > 0 JOIN z ON z.cluster = c.cluster AND z.col = c.col
""")
def q_evaluate_report(spark, sf):
    """P-6: the nested report, its numeric part taken out of it again."""
    rep = _evaluated(spark, sf)["report"]
    count = lambda c, name: F.size(c).cast("long").alias(name)
    flat = rep.select("cluster", "size", F.round("proportion", 6).alias("proportion"), "interpretation_label",
                      F.array_join("representative", ", ").alias("representative"), F.array_join("ambiguous", ", ").alias("ambiguous"),
                      F.round("dominance_signals.top_type_share", 6).alias("top_type_share"),
                      F.round("dominance_signals.top_source_share", 6).alias("top_source_share"), count("genres", "n_genres"),
                      count("p_brand", "n_types"), count("size_class", "n_sources"),
                      F.array_join("top_numeric_features_by_z_score", ", ").alias("top_numeric_features"), F.inline("numeric_distributions"))
    return flat.select(*[c for c in flat.columns if c not in ("mean", "median", "std", "p25", "p75", "z_score_vs_global")],
                       *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("mean", "median", "std", "z_score_vs_global")])


# ---------------------------------------------------------------- records of a search, from given tables
from clusterlens.operators import records as REC  # noqa: E402

_SEED_FIELDS = {"silhouette": "double", "inertia": "double", "davies_bouldin": "double", "bic": "double", "lower_bound": "double",
                "smallest_cluster_proportion": "double", "converged": "boolean", "degenerate_component": "boolean", "run": "string",
                "source": "string"}
#: Line items stand in for fits: the line number is the candidate, the order's number modulo 3 the seed.
_FIT_SQL = """
fits AS (SELECT CAST(l_linenumber AS INTEGER) AS candidate, CAST(l_orderkey % 3 + 42 AS INTEGER) AS seed,
  CAST(l_linenumber + 1 AS INTEGER) AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'diag' ELSE 'full' END AS covariance_type,
  round(avg(l_discount), 6) AS silhouette, round(avg(l_extendedprice), 2) AS inertia, round(avg(l_quantity), 6) AS davies_bouldin,
  CASE WHEN l_linenumber >= 3 THEN round(avg(l_quantity) * 10, 4) END AS bic,
  CASE WHEN l_orderkey % 3 < 2 THEN round(avg(l_tax), 6) END AS lower_bound,
  round(avg(l_tax) * l_linenumber / 10, 6) AS smallest_cluster_proportion,
  NOT (l_linenumber = 6 AND l_orderkey % 3 = 1) AS converged,
  l_linenumber = 4 OR (l_linenumber = 5 AND l_orderkey % 3 = 0) AS degenerate_component
  FROM lineitem GROUP BY l_linenumber, l_orderkey % 3),
agg AS (SELECT candidate, k, covariance_type,
  avg(silhouette) AS silhouette, CASE WHEN count(silhouette) > 1 THEN stddev_pop(silhouette) END AS silhouette_std,
  avg(inertia) AS inertia, avg(davies_bouldin) AS davies_bouldin, avg(bic) AS bic,
  avg(lower_bound) AS lower_bound, CASE WHEN count(lower_bound) > 1 THEN stddev_pop(lower_bound) END AS lower_bound_std,
  avg(smallest_cluster_proportion) AS smallest_cluster_proportion, bool_and(converged) AS converged,
  bool_and(degenerate_component) AS degenerate_component, bool_or(degenerate_component) AS degenerate_any_seed,
  CAST(count(*) AS INTEGER) AS seed_count, min(seed) AS random_seed,
  CASE WHEN k = 8 THEN NULL ELSE 0.3 + 0.1 * k END AS stability_ari_mean FROM fits GROUP BY candidate, k, covariance_type),
guarded AS (SELECT *, smallest_cluster_proportion >= 0.005 AS passes_size_guardrail,
  NOT degenerate_component AS passes_degenerate_guardrail, coalesce(stability_ari_mean, 1.0) >= 0.6 AS passes_stability_guardrail,
  smallest_cluster_proportion >= 0.005 AND NOT degenerate_component AS selection_valid FROM agg),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY selection_valid DESC, passes_stability_guardrail DESC, silhouette DESC NULLS LAST,
  davies_bouldin NULLS LAST, inertia NULLS LAST, coalesce(stability_ari_mean, -1.0) DESC, k) AS INTEGER) AS selection_rank FROM guarded)"""


def _fit_records(spark, sf):
    """One record for each fit, of two shapes: candidates from 3 on also have a BIC."""
    li = tbl(spark, sf, "lineitem")
    line, order = F.col("l_linenumber"), F.col("l_orderkey") % 3
    g = li.groupBy(line.cast("int").alias("candidate"), order.alias("o")).agg(
        *[F.avg(c).alias(c) for c in ("l_discount", "l_extendedprice", "l_quantity", "l_tax")])
    o, c = F.col("o"), F.col("candidate")
    base = g.select(
        "candidate", (o + 42).cast("int").alias("seed"), (c + 1).cast("int").alias("k"),
        F.when(c % 2 == 0, "diag").otherwise("full").alias("covariance_type"), F.round("l_discount", 6).alias("silhouette"),
        F.round("l_extendedprice", 2).alias("inertia"), F.round("l_quantity", 6).alias("davies_bouldin"),
        F.round(F.col("l_quantity") * 10, 4).alias("bic"), F.when(o < 2, F.round("l_tax", 6)).alias("lower_bound"),
        F.round(F.col("l_tax") * c / 10, 6).alias("smallest_cluster_proportion"), (~((c == 6) & (o == 1))).alias("converged"),
        ((c == 4) | ((c == 5) & (o == 0))).alias("degenerate_component"), F.concat(F.lit("run-"), o).alias("run"),
        F.lit("lineitem").alias("source"))
    keys = ["candidate", "seed", "k", "covariance_type"]
    return REC.union_records(REC.as_records(base.filter(c < 3).drop("bic"), keys), REC.as_records(base.filter(c >= 3), keys))


def _candidate_table(spark, sf):
    table = SEL.seed_aggregate(_fit_records(spark, sf), _SEED_FIELDS)
    return table.withColumn("stability_ari_mean", F.when(F.col("k") != 8, F.lit(0.3) + F.lit(0.1) * F.col("k")))


@register("seed_aggregate", f"""
WITH {_FIT_SQL}
SELECT candidate, k, covariance_type, round(silhouette, 4) + 0.0 AS silhouette, round(silhouette_std, 4) + 0.0 AS silhouette_std,
  round(bic, 4) + 0.0 AS bic, round(lower_bound, 4) + 0.0 AS lower_bound, round(lower_bound_std, 4) + 0.0 AS lower_bound_std,
  converged, degenerate_component, degenerate_any_seed, CAST(NULL AS VARCHAR) AS run, 'lineitem' AS source, seed_count, random_seed FROM agg
""")
def q_seed_aggregate(spark, sf):
    """A-30 / U-3: records of two shapes over three seeds; texts stay only where all seeds agree."""
    return rounded(SEL.seed_aggregate(_fit_records(spark, sf), _SEED_FIELDS).select(
        "candidate", "k", "covariance_type", "silhouette", "silhouette_std", "bic", "lower_bound", "lower_bound_std", "converged",
        "degenerate_component", "degenerate_any_seed", "run", "source", "seed_count", "random_seed"), 4)


@register("guardrails", f"""
WITH {_FIT_SQL}
SELECT candidate, k, passes_size_guardrail, passes_degenerate_guardrail, passes_stability_guardrail, selection_valid FROM guarded
""")
def q_guardrails(spark, sf):
    """M-17: guardrail flags of a candidate table."""
    return SEL.guard(_candidate_table(spark, sf)).select(
        "candidate", "k", "passes_size_guardrail", "passes_degenerate_guardrail", "passes_stability_guardrail", "selection_valid")


def _ranked(spark, sf):
    return SEL.rank(SEL.guard(_candidate_table(spark, sf)), SEL.KMEANS_SCORING)


@register("rank_candidates", f"""
WITH {_FIT_SQL}
SELECT selection_rank, candidate, k, selection_valid, passes_stability_guardrail, round(silhouette, 6) + 0.0 AS silhouette FROM ranked
""")
def q_rank_candidates(spark, sf):
    """K-1: valid before stable before the scoring metrics."""
    return rounded(_ranked(spark, sf).select("selection_rank", "candidate", "k", "selection_valid", "passes_stability_guardrail", "silhouette"))


@register("selection_summary", f"""
WITH {_FIT_SQL}, b AS (SELECT * FROM ranked WHERE k = 4 AND covariance_type = 'full')
SELECT 'silhouette' AS selection_metric_primary, 'davies_bouldin' AS selection_metric_secondary, 'inertia' AS selection_metric_tertiary,
  (SELECT count(*) FROM ranked) AS candidate_count, (SELECT count(*) FROM ranked WHERE selection_valid) AS valid_candidate_count,
  k AS best_k, covariance_type AS best_covariance_type, selection_rank AS best_rank, selection_valid AS best_valid,
  round(silhouette, 6) + 0.0 AS best_silhouette, round(davies_bouldin, 6) + 0.0 AS best_davies_bouldin, round(inertia, 6) + 0.0 AS best_inertia FROM b
""")
def q_selection_summary(spark, sf):
    """M-19 / J-8: counts, and the row that has all of the given best parameters."""
    return rounded(SEL.selection_summary(_ranked(spark, sf), SEL.KMEANS_SCORING, {"k": 4, "covariance_type": "full"}))


@register("candidate_warnings", f"""
WITH {_FIT_SQL}, w AS (
  SELECT candidate, k, covariance_type, 'degenerate' AS kind, 1.0::DOUBLE AS value FROM ranked WHERE degenerate_component
  UNION ALL SELECT candidate, k, covariance_type, 'imbalance', smallest_cluster_proportion FROM ranked WHERE smallest_cluster_proportion < 0.01
  UNION ALL SELECT candidate, k, covariance_type, 'low_stability', stability_ari_mean::DOUBLE FROM ranked WHERE stability_ari_mean < 0.6)
SELECT candidate, k, covariance_type, kind, round(value, 6) + 0.0 AS value FROM w
""")
def q_candidate_warnings(spark, sf):
    """M-18: warnings of the candidate table."""
    return rounded(SEL.warnings(_ranked(spark, sf)).drop("message"))
