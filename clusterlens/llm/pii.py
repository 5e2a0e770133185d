"""Personal data: overlapping candidate spans from high-recall generators, scored by boosted trees."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN_TYPE, as_spans, attach, regex_hits, span_text, staged, stored, text_or_empty

#: Labelled candidates on which the trees and the threshold are fitted, at most (the smallest hashes of all candidates).
TRAIN_ROWS = 20_000
#: Precision that the threshold must reach on all candidates but those the trees were fitted on.
TARGET_PRECISION = 0.95
TREES, DEPTH = 8, 3

#: Base patterns (fixed values of the contract), written so that Java scans each run of characters once:
#: possessive repeats, and a match starts where a run starts or the match before it ended. What must not stand before a
#: match is looked up behind its first character, so most characters fail at once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators of further candidates: written-out or spaced addresses, numbers with group marks, grouped identifiers.
GENERATORS = {
    "contact": r"(?<![^\s@<>(),;\[\]])[^\s@<>(),;\[\]]++\x20?(?:@|\(at\)|\[at\])\x20?[^\s@<>(),;\[\]]++",
    "number": r"(?:[+(](?<![0-9A-Za-z][+(])[0-9]|[0-9](?<![0-9A-Za-z][0-9]))(?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "identifier": r"[A-Z](?<![0-9A-Za-z][A-Z])[A-Z][0-9]{2}(?:[\x20-]?[0-9A-Z]{4}){2,7}+(?![0-9A-Za-z])",
}

_CONTEXT_WORDS = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|ssn|address|host|server|ip)\W{0,4}$"

FEATURES = ["length", "digits", "letters", "separators", "groups", "has_at", "dots", "leads_plus", "brackets", "luhn",
            "octets_fit", "context_word", "before_space", "after_space", "dashes", "longest_group"]


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]++", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    chars = F.reverse(F.split(digits, ""))
    total = F.aggregate(
        F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _octets_fit(hit: Column) -> Column:
    """Every dot-separated part is at most 255; leading zeros do not count, however many."""
    return F.forall(F.split(hit, r"\.", -1), lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def base_hits(text: Column) -> dict[str, Column]:
    """Matches of the base patterns that pass their checks, by kind. ``text`` must not be null."""
    n_digits = lambda h: F.length(digits_of(h["hit"]))
    return {
        "email": regex_hits(text, EMAIL, needs=F.contains(text, F.lit("@"))),
        "ip": F.filter(regex_hits(text, IP), lambda h: _octets_fit(h["hit"])),
        "card": F.filter(regex_hits(text, CARD), lambda h: luhn(digits_of(h["hit"]))),
        "phone": F.filter(regex_hits(text, PHONE, needs=F.contains(text, F.lit("+"))), lambda h: n_digits(h).between(9, 15))}


def _features(h: Column) -> list[Column]:
    s = h["hit"]
    count = lambda p: F.regexp_count(s, F.lit(p)).cast("double")
    groups = F.regexp_extract_all(s, F.lit("[0-9]++"), F.lit(0))
    return [F.length(s).cast("double"), count("[0-9]"), count(r"\p{L}"), count(r"[\s().-]"),
            F.size(groups).cast("double"), count("@|\\(at\\)|\\[at\\]"), count(r"\."), F.startswith(s, F.lit("+")).cast("double"),
            count(r"[()]"), luhn(digits_of(s)).cast("double"),
            (F.rlike(s, F.lit(r"^[0-9]+(\.[0-9]+){3}$")) & _octets_fit(s)).cast("double"),
            F.rlike(h["before"], F.lit(_CONTEXT_WORDS)).cast("double"),
            F.rlike(h["before"], F.lit(r"(^|\s)$")).cast("double"), F.rlike(h["after"], F.lit(r"^(\s|[.,;]|$)")).cast("double"),
            count("-"), F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double")]


CAND_TYPE = "array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean,x:array<double>>>"


def _candidates(base_spans: Column, hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["end"].alias("end"),
        F.exists(base_spans, lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])).alias("base"),
        F.array(*_features(h)).alias("x")))


def with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``__email`` ... ``__phone`` (base spans), ``__base`` (all of them) and ``__cand`` (candidates)."""
    s = staged(df, {"__text": text_or_empty(F.col(f"`{text_col}`"))})
    hits = base_hits(F.col("__text"))
    s = staged(s, {f"__{k}": as_spans(hits[k], i, k).cast(SPAN_TYPE) for i, k in enumerate(KINDS)})
    s = staged(s, {"__base": F.concat(*[F.col(f"__{k}") for k in KINDS])})
    marks = [F.contains(F.col("__text"), F.lit(m)) for m in ("@", "(at)", "[at]")]
    needs = {"contact": marks[0] | marks[1] | marks[2]}
    s = staged(s, {f"__g_{k}": regex_hits(F.col("__text"), p, needs=needs.get(k)) for k, p in GENERATORS.items()})
    cand = F.concat(*[_candidates(F.col("__base"), F.col(f"__g_{k}"), len(KINDS) + i, k).cast(CAND_TYPE)
                      for i, k in enumerate(GENERATORS)])
    return staged(s, {"__cand": cand}).drop(*[f"__g_{k}" for k in GENERATORS])


class SpanScorer:
    """Boosted trees as a column expression over the feature array, and the calibrated threshold."""

    def __init__(self, trees: list[tuple[float, str]], threshold: float):
        self.trees, self.threshold = trees, threshold

    def probability(self, x: Column) -> Column:
        margin = F.lit(0.0)
        for weight, dump in self.trees:
            margin = margin + F.lit(weight) * _tree_column(dump, x)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


def _tree_column(dump: str, x: Column) -> Column:
    """The printed tree of Spark ML as nested conditions."""
    lines = [ln.strip() for ln in dump.splitlines()[1:] if ln.strip()]

    def node(i):
        if lines[i].startswith("Predict:"):
            return F.lit(float(lines[i].split(":")[1])), i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        left, i = node(i + 1)
        right, i = node(i + 1)  # skips the Else line
        return F.when(x.getItem(int(m[1])) <= float(m[2]), left).otherwise(right), i

    return node(0)[0]


def fit_scorer(with_cand: DataFrame, train_rows: int = TRAIN_ROWS, precision: float = TARGET_PRECISION) -> SpanScorer | None:
    """Fit trees on candidates labelled by whether they hold a checked base span; null if one label is missing.

    The trees are fitted on the ``train_rows`` smallest hashes of distinct labelled candidates, without a fifth that is held
    out by hash. All other candidates of all texts, with their true counts, decide the threshold: the smallest
    probability from which on precision reaches ``precision``.
    """
    cand = with_cand.select(F.explode("__cand").alias("c")).select(
        F.col("c.base").cast("double").alias("label"), F.col("c.x").alias("x"))
    h = F.xxhash64("x", "label")
    distinct = stored(cand.groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h))
    sample = stored(distinct.orderBy("h", "n").limit(train_rows)).coalesce(1)
    n = {r["label"]: r["k"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("k")).collect()}
    if len(n) < 2:
        return None
    held = F.pmod(F.col("h"), F.lit(5)) == 0
    rows = sample.withColumn("features", array_to_vector("x")).withColumn("w", F.col("n").cast("double"))
    train = rows.filter(~held)
    if train.select("label").distinct().count() < 2:
        train = rows
    last = sample.agg(F.max("h")).first()[0]
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="w",
                          featuresCol="features", labelCol="label").fit(train.orderBy("h", "n"))
    scorer = SpanScorer([(w, t.toDebugString) for w, t in zip(model.treeWeights, model.trees)], 1.1)
    p = F.floor(scorer.probability(F.col("x")) * 100) / 100
    judged = distinct.filter(held | (F.col("h") > last))
    by_p = judged.groupBy(p.alias("p")).agg(
        F.sum(F.col("n") * F.col("label")).alias("good"), F.sum("n").alias("all")).collect()  # at most 101 rows
    good = total = 0.0
    for r in sorted(by_p, key=lambda r: -r["p"]):
        good, total = good + r["good"], total + r["all"]
        if good < precision * total:
            break
        scorer.threshold = r["p"]
    return scorer


def find_pii(df: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans`` (start, rank, kind, end; code points, end exclusive).

    Base spans are the checked matches of the fixed patterns and always stay. Generators propose further, overlapping
    candidates; boosted trees fitted on this table score their format and context, and a candidate that reaches the
    calibrated threshold and overlaps no base span is added. Null and empty texts have no spans. Rows are kept one to
    one, input columns named like a result are replaced, an empty table gives an empty result; a table without both
    labels adds no spans. Long texts cost time in proportion to their length.
    """
    s = with_candidates(df, text_col)
    scorer = fit_scorer(with_candidates(df.select(F.col(f"`{text_col}`").alias("__t")), "__t"), train_rows)
    added = F.array().cast(SPAN_TYPE)
    if scorer is not None:
        chosen = F.filter("__cand", lambda c: ~c["base"] & (scorer.probability(c["x"]) >= scorer.threshold))
        added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"),
                                                       c["kind"].alias("kind"), c["end"].alias("end"))).cast(SPAN_TYPE)
    out = attach(s, {"base_spans": F.array_sort("__base"), "spans": F.array_sort(F.concat("__base", added))})
    return out.drop("__text", "__base", "__cand", *[f"__{k}" for k in KINDS])


def digest_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    def count_of(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count_of(k) for k in kinds}
    return attach(found, {**counts, "base_sha256": F.sha2(span_text(F.col("base_spans")), 256),
                          "spans": span_text(F.col("spans"))}).drop("base_spans")
