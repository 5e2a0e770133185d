"""Cleaning operators: missing tokens (F-4, A-10), dedup (W-1), median imputation (A-11),
the composed clean step and its summary (A-12)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.text import (clean_label, coerce_numeric, key_digest, normalize_category, normalize_multilabel,
                                        null_tokens, parse_duration_minutes)
from clusterlens.operators.quantiles import medians

DEFAULT_TOKENS = ("unknown", "")


def replace_missing_tokens(df: DataFrame, cols, tokens=DEFAULT_TOKENS) -> DataFrame:
    """F-4: token values (case-insensitive) -> NULL in the given string columns."""
    cols = set(cols)
    return df.select(*[null_tokens(c, tokens).alias(c) if c in cols else F.col(c) for c in df.columns])


def newly_missing_counts(before: DataFrame, cols, tokens=DEFAULT_TOKENS) -> DataFrame:
    """A-10: per column, values that the token replacement turned into NULL (one aggregate)."""
    aggs = []
    for c in cols:
        after = null_tokens(c, tokens)
        aggs += [F.count_if(F.col(c).isNotNull() & after.isNull()).alias(f"{c}__new"),
                 F.count_if(after.isNull()).alias(f"{c}__null")]
    row = before.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__new").alias("newly_missing"),
                                         F.col(f"{c}__null").alias("null_after")) for c in cols]))
    return row.select(stack.alias("s")).select("s.*")


def _row_name(df: DataFrame):
    """A long that names a row by its file and place there, for tables that are read straight from files; else None."""
    name = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        df.select(name).schema
    except AnalysisException:
        return None
    return name.alias("_at")


def dedup(df: DataFrame, keys, order_col: str, keep: str = "first") -> DataFrame:
    """W-1: keep the first / last row per key by ``order_col``, or drop every duplicated key (``keep='none'``).

    Rows of a file scan are found late: a hash aggregate over the 128-bit digest of the key, the order and the row's
    address picks the winners, which then fetch their rows by a semi join on the address. Only the keys and the order
    column are read for the first step, and whole rows are never aggregated. Other tables aggregate whole rows with
    ``min_by`` / ``max_by``, map-side first, so that a hot key never lands whole in one task. Of rows with equal key
    and order one stays.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError("keep must be first, last or none")
    keys = list(keys)
    name = _row_name(df)
    if name is None:
        return _dedup_rows(df, keys, order_col, keep)
    digest = [F.col(k) for k in keys]
    narrow = df.select(*key_digest(digest, ("_d1", "_d2")), F.col(order_col).alias("_order"), name)
    groups = narrow.groupBy("_d1", "_d2")
    if keep == "none":
        won = groups.agg(F.any_value("_at").alias("_w"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
    else:
        pick = F.min_by if keep == "first" else F.max_by
        won = groups.agg(F.coalesce(pick("_at", "_order"), F.any_value("_at")).alias("_w"))
    won = won.select(F.col("_d1").alias("_w1"), F.col("_d2").alias("_w2"), "_w")
    full = df.select("*", *key_digest(digest, ("_d1", "_d2")), name)
    same = (F.col("_d1") == F.col("_w1")) & (F.col("_d2") == F.col("_w2")) & (F.col("_at") == F.col("_w"))
    return full.join(won.hint("shuffle_hash"), same, "left_semi").drop("_d1", "_d2", "_at")


def _dedup_rows(df: DataFrame, keys: list[str], order_col: str, keep: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    if keep == "none":
        out = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("r")).where(F.col("_n") == 1).drop("_n"))
    else:
        pick = F.min_by if keep == "first" else F.max_by
        out = df.groupBy(*keys).agg(F.coalesce(pick(row, F.col(order_col)), F.any_value(row)).alias("r"))
    return out.select(*keys, "r.*").select(*df.columns)


def median_impute(df: DataFrame, cols, method: str = "exact") -> tuple[DataFrame, dict]:
    """A-11: fill NULLs with the exact column median; an all-NULL column is left alone."""
    med = medians(df, cols, method=method)
    fills = {c: med[c] for c in cols if c in med}
    out = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
                      for c in df.columns])
    return out, fills


def clean(df: DataFrame, key: str, numeric=(), categorical=(), multi_label=(), label_cols=None,
          duration_col: str | None = None, tokens=DEFAULT_TOKENS, order_col: str | None = None,
          keep: str = "first", dedup_cols=None) -> tuple[DataFrame, dict]:
    """Composed clean step; returns the cleaned frame and a summary record.

    Labels are cleaned in every string column, or in ``label_cols`` if given. Duplicates are found by ``dedup_cols``
    (the key by default).
    """
    string_cols = [c for c, t in df.dtypes if t == "string"]
    label_cols = string_cols if label_cols is None else label_cols
    types = dict(df.dtypes)
    x = df.select(*[clean_label(c).alias(c) if c in label_cols else F.col(c) for c in df.columns])
    replaced = x.agg(*[F.count_if(F.col(c).isNotNull() & null_tokens(c, tokens).isNull()).alias(c) for c in string_cols]).first() \
        if string_cols else None
    x = replace_missing_tokens(x, string_cols, tokens)
    proj = []
    for c in x.columns:
        if c in numeric and types[c] != "string":
            v = F.col(c).cast("double")
            proj.append(F.when(~F.isnan(v), v).alias(c))
        elif c in numeric:
            proj.append(coerce_numeric(c).alias(c))
        else:
            proj.append(F.col(c))
    if duration_col:
        proj.append(parse_duration_minutes(duration_col).alias("duration_minutes"))
    x = x.select(*proj).where(F.col(key).isNotNull())
    keyed = x
    if order_col:
        x = dedup(x, list(dedup_cols or [key]), order_col, keep)
    x = x.select(*[normalize_category(c).alias(c) if c in categorical
                   else normalize_multilabel(c).alias(c) if c in multi_label else F.col(c) for c in x.columns])
    num = list(numeric) + (["duration_minutes"] if duration_col else [])
    any_null = F.lit(False)
    for c in num:
        any_null = any_null | F.col(c).isNull()
    pre = x.agg(F.count(F.lit(1)).alias("rows_out"), F.count_if(any_null).alias("rows_imputed")).first()
    x, fills = median_impute(x, num)
    rows_in = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    with_key = keyed.agg(F.count(F.lit(1)).alias("n")).first()["n"] if order_col else pre["rows_out"]
    # D-2: true row count and column count of the imputation, named so
    summary = {"rows_in": rows_in, "rows_out": pre["rows_out"], "rows_dropped": rows_in - pre["rows_out"],
               "duplicates_removed": with_key - pre["rows_out"],
               "tokens_replaced": {c: replaced[c] for c in string_cols},
               "rows_imputed": pre["rows_imputed"], "imputed_columns": sorted(fills), "medians": fills}
    return x, summary
