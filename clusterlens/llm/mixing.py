"""Mixing sources to target weights: pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents that one fold pairs up; residuals of so many folds meet in the next level of the tree.
FAN_IN = 64
#: No document is taken more often than this.
MAX_COPIES = 2.0



def source_targets(per_source: DataFrame, weights: tuple[float, ...], share: float, cap: float = MAX_COPIES) -> DataFrame:
    """``per_source`` with ``target``: ``share`` of all sizes by weight, none above ``cap`` times its source's size.

    Weights repeat over the sources by code point, null last. What a capped source leaves is shared again by weight:
    the targets are min(cap * size, level * weight), and each pass over the source table raises the level until no
    further source is capped. If all are capped, the rest of the budget stays unused.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source, not per document
    ranked = stored(per_source.withColumn("weight", F.get(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))))
    top = F.col("source_size") * F.lit(float(cap))
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_capped = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > top
        r = ranked.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, top)).alias("used"),
                       F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if r["n"] == n_capped or not r["open"]:
            break
        n_capped, level = r["n"], (budget - (r["used"] or 0.0)) / r["open"]
    full = not r["open"]
    return ranked.withColumn("target", top if full else F.least(top, F.lit(level) * F.col("weight"))).drop("weight")


def _coin(seed: int, level: int, a: Column, b: Column) -> Column:
    h = F.xxhash64(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"])
    return F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))


def _fold(items: Column, item_type: str, seed: int, level: int) -> Column:
    """Pair the fractional documents of one list one after the other; returns the settled ones and the residual.

    Two documents with shares p, q and sizes s, t keep the words p*s + q*t: mass moves until one share is 0 or 1.
    Which way is drawn so that every document keeps its expected share.
    """
    item = items.getItem(0)
    done0 = F.array().cast(f"array<{item_type}>")
    put = lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["copies"].alias("copies"),
                                x["count"].alias("count"), p.cast("double").alias("p"))
    eps = 1e-9

    def step(acc, x):
        r = acc["rest"]
        s, t = r["size"].cast("double"), x["size"].cast("double")
        p, q = r["p"], x["p"]
        up = F.least((1 - p) * s, q * t)      # words that r can gain from x
        down = F.least(p * s, (1 - q) * t)    # words that x can gain from r
        gain = F.when(_coin(seed, level, r, x) * (up + down) < down, up).otherwise(-down)
        p2, q2 = p + gain / s, q - gain / t
        snap = lambda v: F.when(v < eps, 0.0).when(v > 1 - eps, 1.0).otherwise(v)
        r2, x2 = put(r, snap(p2)), put(x, snap(q2))
        r_done = r2["p"].isin(0.0, 1.0)
        return F.struct(
            F.concat(acc["done"], F.array(F.when(r_done, r2).otherwise(x2))).alias("done"),
            F.when(r_done, x2).otherwise(r2).alias("rest"))

    start = F.struct(done0.alias("done"), item.cast(item_type).alias("rest"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def mix(docs: DataFrame, weights: tuple[float, ...], share: float = 1.5, id_col: str = "doc_id",
        source_col: str = "source", size_col: str = "size", seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of each document so that every source gives about its target: one row per row of ``docs``.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size).
    ``weights`` repeat over the sources by code point, null last; ``share`` is the budget over all sizes. Every document of a source has the same expected copies r = target / source size, at most 2.
    It gets floor(r) copies, and pivotal rounding settles the fraction: lists of ``fan_in`` documents are folded in
    parallel, the one residual of each list goes on to the next level, until one is left for each source, which is
    drawn. A source's taken words so miss their target by less than its largest document; draws are hashes of the rows,
    so reruns agree. Equal rows (same id, source and size) are folded as one row with a count. Null ids and sources are
    values like others; null or zero sizes take nothing. Extra columns of ``docs`` are ignored; an empty table gives an
    empty result.
    """
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                        F.col(f"`{source_col}`").cast("string").alias("source"),
                        F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
            .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("count")))
    rows = stored(rows)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item_type = f"struct<doc_id:{id_type},size:bigint,copies:bigint,count:bigint,p:double>"
    per_source = (rows.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"),
                                             F.count_if(F.col("size") > 0).alias("n_docs")))
    targets = stored(source_targets(per_source, weights, share))
    withr = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mass = ratio * F.col("count")
    base = F.floor(mass + 1e-9)
    staged = withr.withColumn("copies", F.when(F.col("size") > 0, base).otherwise(0).cast("long")) \
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(mass - base, F.lit(0.0))).otherwise(0.0))
    item = F.struct(*[F.col(c) for c in ("doc_id", "size", "copies", "count", "p")]).cast(item_type).alias("item")
    cols = ["source", "source_size", "target", "n_docs"]
    settled = [staged.filter(F.col("p") < 1e-9).select(*cols, item)]
    level_rows = staged.filter(F.col("p") >= 1e-9).select(*cols, item)
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    level, width = 0, most
    while width > 1:
        # lists of about fan_in rows of one source; the last level has one list per source
        width = -(-width // fan_in)
        lists = F.ceil(F.col("n_docs") / F.lit(float(fan_in) ** (level + 1))).cast("long")
        key = F.when(lists <= 1, F.lit(0).cast("long")).otherwise(
            F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "item.doc_id", "item.size"), lists))
        folded = (level_rows.withColumn("__list", key)
                  .groupBy(*cols, "__list").agg(F.array_sort(F.collect_list("item")).alias("items"))
                  .select(*cols, _fold(F.col("items"), item_type, seed, level).alias("f")))
        folded = stored(folded)
        settled.append(folded.select(*cols, F.explode("f.done").alias("item")))
        level_rows = folded.select(*cols, F.col("f.rest").alias("item"))
        settled.append(level_rows.filter(F.col("item.p").isin(0.0, 1.0)))
        level_rows = level_rows.filter(~F.col("item.p").isin(0.0, 1.0))
        level += 1
    coin = F.pmod(F.xxhash64(F.lit(seed + 2), "item.doc_id", "item.size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = level_rows.withColumn("item", F.col("item").withField("p", F.when(coin < F.col("item.p"), 1.0).otherwise(0.0)))
    settled.append(last)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    total = F.col("item.copies") + F.col("item.p").cast("long")
    each, extra = F.floor(total / F.col("item.count")), F.pmod(total, F.col("item.count"))
    return (out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("item.count"))))
            .select(F.col("item.doc_id").alias("doc_id"), "source", F.col("item.size").alias("size"), "source_size",
                    "target", (each + F.when(F.col("k") <= extra, 1).otherwise(0)).cast("long").alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))
