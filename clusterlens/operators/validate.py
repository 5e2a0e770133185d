"""Row-level validation (V-1..V-10): flag frame, one-aggregate report, reject split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.text import coerce_numeric, key_digest, parse_duration_minutes


#: Matches at the first character that is no white space of any kind.
_INK = r"(?U)[^\s\x1c-\x1f]"


def _blank(c):
    """NULL, or nothing but white space of any kind."""
    return ~F.coalesce(F.col(c).cast("string").rlike(_INK), F.lit(False))


def _number(c):
    """Values that are no number are NULL, and so fail no range check."""
    return coerce_numeric(c)


def flag_frame(df: DataFrame, key: str, name: str | None = None, ranges=None, nonneg=(), positive=(),
               duration_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """Add one boolean column per check. NULL values never fail a range check.

    The duplicate-key flag joins the digests of keys that occur twice back to the rows, instead of a window that would sort
    a hot key inside one task: 128 bits of a key are counted (map-side first), and only digests of repeated keys are
    on the other side of the join, which AQE broadcasts while they are few and splits where one key is hot.
    """
    flags = {f"missing_{key}": _blank(key)}
    if name:
        flags[f"missing_{name}"] = _blank(name)

    def invalid(c, fails):  # a column of several rule groups fails if one of them does
        fails = F.coalesce(fails, F.lit(False))
        flags[f"invalid_{c}"] = flags[f"invalid_{c}"] | fails if f"invalid_{c}" in flags else fails

    for c, (lo, hi) in (ranges or {}).items():
        invalid(c, ~_number(c).between(lo, hi))
    for c in nonneg:
        invalid(c, _number(c) < 0)
    for c in positive:
        invalid(c, _number(c) <= 0)
    if duration_col:
        flags[f"invalid_{duration_col}"] = (F.trim(F.coalesce(F.col(duration_col), F.lit(""))) != "") & \
            parse_duration_minutes(duration_col).isNull()
    digest = key_digest([F.col(key)], ("_d1", "_d2"))
    out = df.select("*", *[v.alias(k) for k, v in flags.items()], *digest)
    dup = df.select(*key_digest([F.col(key)], ("_e1", "_e2"))).groupBy("_e1", "_e2").agg(F.count(F.lit(1)).alias("_dup_n")) \
        .where(F.col("_dup_n") > 1)
    out = out.join(dup, (F.col("_d1") == F.col("_e1")) & (F.col("_d2") == F.col("_e2")), "left")
    out = out.withColumn(f"duplicate_{key}", F.col("_dup_n").isNotNull()).drop("_d1", "_d2", "_e1", "_e2", "_dup_n")
    return out, list(flags) + [f"duplicate_{key}"]


def validate(df: DataFrame, key: str, name: str | None = None, ranges=None, nonneg=(), positive=(),
             duration_col: str | None = None, strict: bool = False):
    """Return (report one-row DataFrame, rejected rows with rejection_reasons).

    ``warning_rows`` counts every row that fails any check, rejected or not."""
    flagged, names = flag_frame(df, key, name, ranges, nonneg, positive, duration_col)
    hard = [f"missing_{key}"] + ([f"missing_{name}"] if name else [])
    reject_on = names if strict else hard
    any_reject = F.lit(False)
    for f in reject_on:
        any_reject = any_reject | F.col(f)
    any_flag = F.lit(False)
    for f in names:
        any_flag = any_flag | F.col(f)
    reasons = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in names]), lambda x: x.isNotNull())
    report = flagged.agg(F.count(F.lit(1)).alias("rows"),
                         *[F.count_if(F.col(f)).alias(f) for f in names],
                         F.count_if(any_reject).alias("rejected_rows"),
                         F.count_if(any_flag).alias("warning_rows"))
    rejected = flagged.where(any_reject).select(*df.columns, reasons.alias("rejection_reasons"))
    return report, rejected
