"""Data stages over column roles: transform, feature matrix, evaluation (F-15, F-16, A-15..A-18, P-4..P-7).

A table's columns are described once by ``Roles``; every stage takes what is there. Role columns that a table lacks are
left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.functions.text import coerce_numeric, leading_token, log1p_clipped, normalize_category, parse_multilabel
from clusterlens.operators import evaluate as EV
from clusterlens.operators import features as FE
from clusterlens.operators import lift as L
from clusterlens.plans import workflow as WF


@dataclass(frozen=True)
class Roles:
    """What the columns of a table are for.

    ``log``: numeric columns whose features use log(1 + x) instead of x. ``extra_numeric``: numbers that are features
    besides the numeric columns (a parsed duration). ``multi_label``: texts of labels joined by ``|``. ``leading``: {new
    categorical column: column whose first word it is}. ``excluded``: columns that are never features.
    """

    ids: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    multi_label: tuple[str, ...] = ()
    log: tuple[str, ...] = ()
    extra_numeric: tuple[str, ...] = ()
    leading: dict[str, str] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()
    min_frequency: float = 0.01
    vocab_size: int = 50

    def present(self, names: tuple[str, ...], columns: list[str]) -> list[str]:
        return [c for c in names if c in columns]


def log_name(column: str) -> str:
    return f"{column}_log1p"


def log_preferred(roles: Roles, columns: list[str]) -> list[str]:
    """F-15: for each numeric column its log column if the table has it, else the column; then the extra numbers."""
    out = [log_name(c) if log_name(c) in columns else c for c in roles.numeric if c in columns or log_name(c) in columns]
    return out + [c for c in roles.extra_numeric if c in columns and c not in out]


def candidate_features(roles: Roles, columns: list[str]) -> list[str]:
    """F-16: all columns of a transformed table but identifiers and excluded ones, in order."""
    return [c for c in columns if c not in {*roles.ids, *roles.excluded}]


def _tag_column(base: str, tag: str) -> str:
    return f"{base}__{tag}"


def transform(df: DataFrame, roles: Roles) -> tuple[DataFrame, dict]:
    """The transformed table and its metadata: numbers coerced, ``<column>_log1p`` added, categories normalised, leading
    words taken, and one 0/1 column ``<column>__<tag>`` for each of the most frequent tags.

    One projection; only the tag vocabularies are found beforehand, all in one pass.
    """
    cols = df.columns
    leading = {new: c for new, c in roles.leading.items() if c in cols}
    x = df.select("*", *[leading_token(c).alias(new) for new, c in leading.items()]) if leading else df
    types = dict(x.dtypes)
    numeric = roles.present(roles.numeric + tuple(c for c in roles.extra_numeric if c not in roles.numeric), x.columns)
    categorical = roles.present(roles.categorical, x.columns)
    tags = {c: parse_multilabel(c) for c in roles.present(roles.multi_label, x.columns)}
    number = lambda c: coerce_numeric(c) if types[c] == "string" else F.when(
        ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    _, vocab = FE.level_counts(x, [], 0.0, tags, roles.vocab_size)
    logs = [c for c in roles.log if c in numeric]
    flat = x.select(*[number(c).alias(c) if c in numeric else normalize_category(c).alias(c) if c in categorical else F.col(c)
                      for c in x.columns],
                    *[h for c in tags for h in FE.multi_hot_columns(tags[c], c, vocab[c])])
    out = flat.select("*", *[log1p_clipped(c).alias(log_name(c)) for c in logs])
    return out, {"identifier_columns": roles.present(roles.ids, cols), "numeric_columns": roles.present(roles.numeric, cols),
                 "categorical_columns": categorical, "multi_label_columns": list(tags),
                 "log_transformed_columns": [log_name(c) for c in logs], "multi_label_vocabularies": vocab,
                 "final_candidate_feature_columns": candidate_features(roles, out.columns)}


def feature_matrix(transformed: DataFrame, roles: Roles) -> tuple[DataFrame, list[str], DataFrame]:
    """(ids and features, feature names, wide table) of a transformed table: standardised numbers, one-hot categories, and
    the tag columns as they are."""
    hot = sorted(c for c in transformed.columns if any(c.startswith(f"{base}__") for base in roles.multi_label))
    ids = roles.present(roles.ids, transformed.columns)
    _, names, wide = FE.build_features(transformed.select(*[F.col(f"`{c}`") for c in transformed.columns]), ids + hot,
                                       numeric=log_preferred(roles, transformed.columns),
                                       categorical=roles.present(roles.categorical, transformed.columns),
                                       min_frequency=roles.min_frequency)
    names = names + hot
    wide = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return FE.as_matrix(wide, ids, names), names, wide


def evaluate(assigned: DataFrame, meta: DataFrame, roles: Roles, name_col: str | None = None, type_col: str | None = None,
             source_col: str | None = None, warn_share: float = 0.8) -> dict[str, DataFrame]:
    """Cluster sizes, profile and nested report of an assignment, from the rows' metadata joined by the ids.

    ``meta`` is the cleaned table; types and sources are the first two categorical columns unless named.
    """
    ids = roles.present(roles.ids, meta.columns)
    rows = WF.metadata_join(assigned.select(*ids, "cluster", "max_probability", "assignment_entropy"), meta, ids)
    categorical = roles.present(roles.categorical, meta.columns)
    type_col = type_col or categorical[0]
    source_col = source_col or (categorical[1] if len(categorical) > 1 else None)
    numeric = [c for c in roles.present(roles.numeric, meta.columns) if not isinstance(meta.schema[c].dataType, T.StringType)]
    base = roles.present(roles.multi_label, meta.columns)
    tags = parse_multilabel(base[0]) if base else F.array().cast("array<string>")
    genres = L.multilabel_lift(rows, "cluster", tags, 8)
    types = L.category_lift(rows, "cluster", type_col, 5)
    sources = L.category_lift(rows, "cluster", source_col, 5) if source_col else None
    sizes = EV.cluster_sizes(rows, "cluster")
    labels = EV.interpretation_labels(genres, types, sources, rows.select("cluster"))
    shifts = EV.top_z_features(EV.cluster_numeric(rows, "cluster", numeric), 4)
    names = EV.examples(rows, "cluster", name_col) if name_col else None
    return {"sizes": sizes,
            "profile": EV.cluster_profile(sizes, genres, types, shifts, labels, warn_share, sources, names),
            "report": WF.distribution_report(rows, tags, categorical, numeric, name_col, type_col, source_col, warn_share)}
