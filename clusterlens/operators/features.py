"""Feature engineering (F-11, F-14..F-17, A-13..A-20, J-3).

The matrix is ``(id..., features array<double>)`` plus a driver-side list of
feature names. Only model-sized facts are collected: per-column means / std,
the retained one-hot levels and the tag vocabulary (<= ``vocab_size``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.operators.quantiles import medians

INFREQUENT = "infrequent_sklearn"


def tag_vocab(df: DataFrame, tags, size: int = 50) -> DataFrame:
    """A-13: explode tags, count, order by (count desc, tag), keep ``size`` (distributed top-k)."""
    counts = (df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    top = counts.orderBy(F.col("n").desc(), F.col("tag")).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("tag"))))


def multi_hot_columns(tags, prefix: str, vocab, dtype: str = "int") -> list:
    """F-14: one 0/1 column per vocabulary tag, names ``<prefix>__<tag>`` (tags sorted)."""
    return [F.array_contains(tags, t).cast(dtype).alias(f"{prefix}__{t}") for t in sorted(vocab)]


#: Columns that one categorical column may become; a frequency bound keeps it below 1 / min_frequency anyway.
MAX_LEVELS = 10_000


def frequent_levels(df: DataFrame, col: str, min_frequency: float) -> tuple[list[str], bool]:
    """A-14: levels with count >= min_frequency * n (alphabetical), and whether any level folds."""
    return level_counts(df, [col], min_frequency)[0][col]


def level_counts(df: DataFrame, categorical, min_frequency: float, tags=None, vocab_size: int = 50) -> tuple[dict, dict]:
    """A-13 / A-14 of all columns in one pass: {column: (retained levels, whether some fold)} and {name: tags by frequency}.

    ``tags``: {name: array column}. Each row gives its levels and tags as (column, value) pairs, which are counted
    together. Only what becomes a feature reaches the driver: levels by their share, at most MAX_LEVELS of a column
    (more is an error), and ``vocab_size`` tags a column, by count and then name.
    """
    categorical, tags = list(categorical), tags or {}
    names = categorical + list(tags)
    if not names:
        return {}, {}
    pair = lambda i, v: F.struct(F.lit(i).alias("c"), v.cast("string").alias("v"))
    parts = [F.array(*[pair(i, F.col(c)) for i, c in enumerate(categorical)])] if categorical else []
    own_pairs = lambda j, t: F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda v: pair(j, v))
    parts += [own_pairs(j, t) for j, t in enumerate(tags.values(), len(categorical))]
    counts = df.select(F.explode(F.concat(*parts)).alias("s")).select("s.*").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    of = Window.partitionBy("c")
    known = F.col("v").isNotNull()
    ranked = counts.withColumn("rows", F.sum("n").over(of)).withColumn("levels", F.count_if(known).over(of)).withColumn("r", place)
    is_tag = F.col("c") >= len(categorical)
    want = F.when(is_tag, known & (F.col("r") <= vocab_size)).otherwise(known & (F.col("n") >= min_frequency * F.col("rows")))
    kept = ranked.filter(want & (F.col("r") <= MAX_LEVELS + 1)).collect()
    by: dict = {}
    for r in sorted(kept, key=lambda r: r["r"]):
        by.setdefault(names[r["c"]], []).append(r)
    levels = {}
    for c in categorical:
        own = by.get(c, [])
        if len(own) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels of a share of {min_frequency} or more")
        levels[c] = (sorted(r["v"] for r in own), bool(own) and len(own) < own[0]["levels"] or not own)
    return levels, {t: [r["v"] for r in by.get(t, [])] for t in tags}


def one_hot_columns(col: str, levels, has_infrequent: bool, prefix: str = "categorical"):
    """A-17: alphabetical retained levels, then the infrequent bucket; unknown -> all zeros."""
    x = F.col(col)
    cols = [(x == F.lit(v)).cast("double").alias(f"{prefix}__{col}_{v}") for v in levels]
    if has_infrequent:
        cols.append((x.isNotNull() & ~x.isin(list(levels))).cast("double")
                    .alias(f"{prefix}__{col}_{INFREQUENT}"))
    return cols


def standardize_stats(df: DataFrame, cols) -> dict:
    """A-16: mean and population std per column (std 0 -> 1), one aggregate."""
    row = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"] if row[f"{c}__s"] not in (None, 0.0) else 1.0) for c in cols}


def standardized_columns(stats: dict, prefix: str = "numeric"):
    return [((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"{prefix}__{c}") for c, (m, s) in stats.items()]


def _imputed_stats(base: DataFrame, cols, med: dict) -> dict:
    """A-16 after A-15: mean and population std of each column with its gaps filled by the median, from one aggregate of
    the values that are there (variances of two parts combine exactly). Std 0 -> 1."""
    row = base.agg(F.count(F.lit(1)).alias("n"), *[a for c in cols for a in (
        F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__m"), F.var_pop(c).alias(f"{c}__v"))]).first()
    out = {}
    for c in cols:
        n, n1 = row["n"], row[f"{c}__n"]
        n0, gap = n - n1, row[f"{c}__m"] - med[c]
        mean = (n1 * row[f"{c}__m"] + n0 * med[c]) / n
        std = math.sqrt((n1 * row[f"{c}__v"] + gap * gap * n1 * n0 / n) / n)
        out[c] = (mean, std if std > 0 else 1.0)
    return out


def build_features(df: DataFrame, id_cols, numeric=(), categorical=(), multi_label=None,
                   min_frequency: float = 0.01, vocab_size: int = 50, quantile_method: str = "exact"):
    """Assemble the matrix. ``multi_label``: {name: array column expression}.

    Returns (DataFrame[id..., features], feature_names, wide DataFrame of named columns).
    Numerics: median-impute (NULL and NaN; columns without a value are dropped), then standardise (population std).
    Categoricals: NULL -> 'missing', min-frequency fold, one-hot. Tags: multi-hot over the vocabulary.
    The input is computed once and kept while medians, moments, and all levels and tags are found, one pass each.
    """
    id_cols, numeric, categorical = list(id_cols), list(numeric), list(categorical)
    multi_label = multi_label or {}
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    base = df.select(*id_cols, *[value(c) for c in numeric],
                     *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categorical],
                     *[expr.alias(f"__tags_{name}") for name, expr in multi_label.items()])
    base = base.persist()
    try:
        med = medians(base, numeric, method=quantile_method) if numeric else {}
        num = [c for c in numeric if c in med]
        stats = _imputed_stats(base, num, med) if num else {}
        levels, vocab = level_counts(base, categorical, min_frequency, {n: F.col(f"__tags_{n}") for n in multi_label}, vocab_size)
    finally:
        base.unpersist()
    base = base.select(*[F.coalesce(F.col(c), F.lit(med[c])).alias(c) if c in num else F.col(c) for c in base.columns])
    cols = standardized_columns(stats)
    for c in categorical:
        cols += one_hot_columns(c, *levels[c])
    for name in multi_label:
        cols += multi_hot_columns(F.col(f"__tags_{name}"), name, vocab[name], "double")
    wide = base.select(*id_cols, *cols)
    names = [c for c in wide.columns if c not in id_cols]
    return as_matrix(wide, id_cols, names), names, wide


def as_matrix(wide: DataFrame, id_cols, names: list[str]) -> DataFrame:
    """S-7: the named columns as one array; their names are kept with it, also in Parquet files."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    return wide.select(*id_cols, values.alias("features", metadata={"feature_names": list(names)}))


def feature_names(matrix: DataFrame, features: str = "features") -> list[str]:
    """The names that ``as_matrix`` kept."""
    return list(matrix.schema[features].metadata.get("feature_names", []))


def unpivot_features(wide: DataFrame, id_cols, names) -> DataFrame:
    """Long form (id..., feature, value) of a wide feature frame."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("double").alias("value"))
                      for n in names])
    return wide.select(*id_cols, F.explode(items).alias("s")).select(*id_cols, "s.feature", "s.value")


def matrix_quality(matrix: DataFrame, names, features: str = "features") -> DataFrame:
    """A-19 / A-20: rows, dims, null and zero cells, rows with a null, duplicate rows, family counts (one pass)."""
    d = len(names)
    families = family_counts(names)
    arr = F.col(features)
    same = matrix.select("*", F.xxhash64(arr).alias("h1"), F.xxhash64(F.lit("second"), arr).alias("h2"))
    # equal rows meet by a digest; each group keeps the sums of its rows
    per = same.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.size(F.filter(arr, lambda v: v.isNull() | F.isnan(v)))).cast("long").alias("null_cells"),
        F.sum(F.size(F.filter(arr, lambda v: v == 0.0))).cast("long").alias("zero_cells"),
        F.count_if(F.exists(arr, lambda v: v.isNull() | F.isnan(v))).alias("rows_with_null"))
    out = per.agg(F.sum(F.col("rows") - 1).alias("duplicate_rows"), *[F.sum(c).alias(c) for c in ("rows", "null_cells", "zero_cells", "rows_with_null")])
    return out.select("rows", F.lit(d).cast("long").alias("dims"), "null_cells", "zero_cells",
                      (F.col("zero_cells") / F.nullif(F.col("rows") * F.lit(d), F.lit(0))).alias("zero_cell_ratio"),
                      "rows_with_null", "duplicate_rows",
                      *[F.lit(n).cast("long").alias(f"{f}_features") for f, n in families.items()])


def family_counts(names: list[str]) -> dict[str, int]:
    """F-17: how many features are numbers, categories and tags."""
    num = sum(n.startswith("numeric__") for n in names)
    cat = sum(n.startswith("categorical__") for n in names)
    return {"numeric": num, "categorical": cat, "multi_hot": len(names) - num - cat}


def feature_gaps(wide: DataFrame, names: list[str]) -> DataFrame:
    """A-19 by feature: (feature, family, nulls, zeros) in one aggregate."""
    value = lambda n: F.col(f"`{n}`").cast("double")
    row = wide.agg(*[a for i, n in enumerate(names) for a in (
        F.count_if(value(n).isNull() | F.isnan(value(n))).alias(f"n{i}"), F.count_if(value(n) == 0).alias(f"z{i}"))])
    family = lambda n: "numeric" if n.startswith("numeric__") else "categorical" if n.startswith("categorical__") else "multi_hot"
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(family(n)).alias("family"), F.col(f"n{i}").alias("nulls"),
                                                  F.col(f"z{i}").alias("zeros")) for i, n in enumerate(names)])))
