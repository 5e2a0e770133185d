"""Exact quantiles (linear interpolation) without a per-group value map.

Spark's ``percentile`` / ``median`` keep every distinct value of a group in one hash map and merge it in one task; with
a hot group (a third of all rows) that is one task holding a third of the column. Here two passes find the same value:

* pass 1: a mergeable sketch for each (group, column) gives, for every wanted rank, a bracket of two values between which
  the rank lies. The sketch's rank error is at most n / ACCURACY, the bracket is a few times as wide;
* pass 2: values inside a bracket are counted one by one, all values between brackets together, with partial
  aggregation. A running sum of the counts by value then says which value holds which rank.

Everything stays on the executors: brackets are a table joined by group and column, and the rows of one group that meet
in a task are its distinct values inside brackets, a few n / ACCURACY. There is no limit on the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketch as a share of the rows, inverted; brackets reach MARGIN times as far to either side.
ACCURACY, MARGIN = 2000, 2


def long_values(df: DataFrame, cols, by=()) -> DataFrame:
    """Unpivot numeric columns to (by..., column, value), non-null, non-NaN."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    out = df.select(*[F.col(b) for b in by], F.explode(items).alias("kv")).select(
        *[F.col(b) for b in by], F.col("kv.column").alias("column"), F.col("kv.value").alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _between(lo: Column, hi: Column, frac: Column) -> Column:
    """Linear interpolation; between a finite and an infinite value the infinite one, between both infinities NaN."""
    inf = float("inf")
    return (F.when((frac == 0) | (lo == hi), lo).when((F.abs(lo) == inf) | (F.abs(hi) == inf), lo * (1 - frac) + hi * frac)
            .otherwise(lo + (hi - lo) * frac))


def _brackets(data: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """keys, n, ranks (from 0) and their brackets (lo, hi)."""
    wide = MARGIN / ACCURACY
    ends = [(max(p - wide, 0.0), min(p + wide, 1.0)) for p in probs]
    asked = sorted({e for pair in ends for e in pair})
    got = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", asked, ACCURACY).alias("q"),
                                  F.min("value").alias("least"), F.max("value").alias("most"))
    place = F.array(*[F.lit(p) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(
        F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)))))
    # at both ends, and in groups where a few ranks more or less count, the bracket reaches the extreme value itself
    few = F.col("n") < 4 * ACCURACY
    lo = lambda e: F.when(few | F.lit(e == 0.0), F.col("least")).otherwise(F.col("q")[asked.index(e)])
    hi = lambda e: F.when(few | F.lit(e == 1.0), F.col("most")).otherwise(F.col("q")[asked.index(e)])
    return got.select(*keys, "n", ranks.alias("ranks"), F.array_distinct(F.array(*[
        F.struct(lo(a).alias("lo"), hi(b).alias("hi")) for a, b in ends])).alias("brackets"))


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join by keys, NULL meeting NULL; the keys of ``rows`` are kept."""
    other = table.select(*[F.col(k).alias(f"t_{k}") if k in keys else F.col(k) for k in table.columns])
    same = None
    for k in keys:
        c = rows[k].eqNullSafe(other[f"t_{k}"])
        same = c if same is None else same & c
    return rows.join(other, same).drop(*[f"t_{k}" for k in keys])


def exact_quantiles(df: DataFrame, cols, probs, by=()) -> DataFrame:
    """Return (by..., column, prob, value, n) with pandas / SQL ``quantile_cont`` semantics; NULL and NaN are left out.

    Lazy; the input is read twice. NULL groups are a group; infinite values take part.
    """
    by, probs = list(by), [float(p) for p in probs]
    names = {b: f"g{i}" for i, b in enumerate(by)}
    data = long_values(df, list(cols), by).select(*[F.col(b).alias(g) for b, g in names.items()], "column", "value")
    keys = [*names.values(), "column"]
    wanted = _brackets(data, keys, probs)
    cells = _met(data, wanted.select(*keys, "brackets"), keys)
    inside = F.exists("brackets", lambda b: F.col("value").between(b["lo"], b["hi"]))
    gap = F.size(F.filter("brackets", lambda b: b["hi"] < F.col("value")))
    # -1 marks a value that stands for itself; between brackets all values of one gap are counted together
    cells = cells.select(*keys, "value", F.when(inside, F.lit(-1)).otherwise(gap).alias("gap"),
                         F.when(inside, F.col("value")).alias("own")).groupBy(*keys, "gap", "own").agg(
        F.count(F.lit(1)).alias("c"), F.min("value").alias("at"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = _met(cells.withColumn("upto", F.sum("c").over(upto)), wanted.select(*keys, "n", "ranks"), keys).withColumn(
        "held", F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))).filter(F.size("held") > 0)
    value = F.when(F.col("gap") == -1, F.col("own")).otherwise(
        F.raise_error(F.lit("the quantile sketch passed its error bound")).cast("double"))
    found = hit.select(*keys, "n", F.explode("held").alias("rank"), value.alias("v")).groupBy(*keys, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    h = lambda p: (F.col("n") - 1) * p
    each = F.explode(F.transform(F.array(*[F.lit(p) for p in probs]), lambda p: F.struct(
        p.alias("prob"), _between(F.col("of")[F.floor(h(p))], F.col("of")[F.ceil(h(p))], h(p) - F.floor(h(p))).alias("value"))))
    return found.select(*keys, "n", each.alias("x")).select(
        *[F.col(g).alias(b) for b, g in names.items()], "column", "x.prob", "x.value", "n")


def approx_quantiles(df: DataFrame, cols, probs, by=(), accuracy: int = 10_000) -> DataFrame:
    """Same output as ``exact_quantiles`` from ``percentile_approx`` (one pass, bounded-memory sketch per
    group, merged map-side); returns an element of the column (no interpolation), rank error ~ 1/accuracy."""
    by = list(by)
    probs = [float(p) for p in probs]
    data = long_values(df, cols, by)
    agg = data.groupBy(*by, "column").agg(
        F.percentile_approx("value", probs, accuracy).alias("q"), F.count(F.lit(1)).alias("n"))
    z = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("q").alias("value"))
    return agg.select(*by, "column", F.explode(z).alias("pq"), "n").select(
        *by, "column", F.col("pq.prob").alias("prob"), F.col("pq.value").alias("value"), "n")


def quantiles(df: DataFrame, cols, probs, by=(), method: str = "exact") -> DataFrame:
    """Dispatch: ``exact`` (two passes, default) or ``approx`` (sketch, one pass)."""
    if method == "approx":
        return approx_quantiles(df, cols, probs, by)
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    return exact_quantiles(df, cols, probs, by)


def medians(df: DataFrame, cols, by=(), method: str = "exact") -> dict:
    """{column: median} (no grouping) or {(group..., column): median}."""
    res = quantiles(df, cols, [0.5], by=by, method=method).collect()
    if not by:
        return {r["column"]: r["value"] for r in res}
    return {(*[r[b] for b in by], r["column"]): r["value"] for r in res}
