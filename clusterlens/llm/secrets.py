"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by likelihood."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN_TYPE, as_spans, attach, regex_hits, staged, stored, text_or_empty

#: Labelled strings for each model, about so many at most.
TRAIN_STRINGS = 20_000
#: Share of held-out ordinary strings that the threshold may let through.
FALSE_POSITIVES = 0.001
#: Share of held-out random strings that may fall below the other end of the threshold's range.
MISSES = 0.01

#: Base patterns (fixed values of the contract).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f](?<![0-9a-f]{2})[0-9a-f]{23,}+"
KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1  # code 0 marks the start
#: Runs of 16 or more characters of the alphabet with a digit among them.
TOKEN = r"[A-Za-z0-9+/_=-](?<![A-Za-z0-9+/_=-]{2})(?:(?<=[0-9])|(?=[A-Za-z+/_=-]*+[0-9]))[A-Za-z0-9+/_=-]{15,}+"
ORDINARY = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{5,}+"
#: Runs of the alphabet, from which the ordinary model learns digits and separators.
RUN = r"[A-Za-z0-9+/_=-]{4,}+"
_PART = r"(?:[0-9]++[a-z]{0,3}|[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+[0-9]{0,4}|[A-Z]++[0-9]{0,4})"
#: A run with a digit whose parts between separators are numbers, words or numbered words: dates, paths, ids, file names.
PLAIN = rf"^(?=[^0-9]*+[0-9])[+/_=-]*+{_PART}(?:[+/_=-]++{_PART})*+[+/_=-]*+$"


def base_hits(text: Column) -> dict[str, Column]:
    """Matches of the base patterns that are long enough, by kind. ``text`` must not be null."""
    return {"assign": F.filter(regex_hits(text, ASSIGN, needs=F.rlike(text, F.lit("[:=]"))), lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 1)) >= 6),
            "access": regex_hits(text, ACCESS, needs=F.contains(text, F.lit("AKIA"))), "hex": regex_hits(text, HEX)}


def _codes(s: Column) -> Column:
    """Places in the alphabet of the characters, the start mark first."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def _pairs(s: Column) -> Column:
    codes = _codes(s)
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)),
                      lambda a, b: a * _SIZE + b)


def _sample_share(df: DataFrame, per_label: int) -> float:
    return min(1.0, per_label / 4 / max(df.select().count(), 1))


def _sampled(digest: Column, part: float) -> Column:
    """Whether the text with this digest teaches the models."""
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") <= F.lit(int(part * (1 << 28)))


def _held(s: Column) -> Column:
    return F.pmod(F.xxhash64(s), F.lit(5)) == 0


def _plain(hits: Column, base: Column) -> Column:
    """The strings of ``hits`` that look plain and overlap no base span."""
    return F.transform(F.filter(hits, lambda h: F.rlike(h["hit"], F.lit(PLAIN)) & ~F.exists(
        base, lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"]))), lambda h: h["hit"])


def labelled_strings(df: DataFrame, text_col: str, part: float) -> DataFrame:
    """``s``, ``label`` (1 random, 0 ordinary) and ``held`` from a bounded sample of the rows.

    Ordinary strings are words and identifiers of the texts without a digit (one in 32, by hash), runs with digits and
    separators outside base spans whose parts are plain (``PLAIN``), and numbers, times and paths rendered from digests of
    the texts. Random ones are the base matches' values, and renderings (hexadecimal, base 64 and its upper case) of the
    digests.
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = (df.select(text.alias("t")).withColumn("h", F.sha2(F.col("t"), 512)).filter(F.length("t") > 0)
            .filter(_sampled(F.col("h"), part)))
    raw = F.unhex(F.substring("h", 9, 80))
    digest = [F.substring("h", 9, 40), F.translate(F.substring(F.base64(raw), 1, 40), "+/", "-_"),
              F.substring(F.base64(raw), 1, 32), F.substring(F.regexp_replace(F.upper(F.base64(raw)), "[^A-Z0-9]", ""), 1, 20)]
    number = lambda at: F.conv(F.substring("h", at, 13), 16, 10)
    time = F.timestamp_seconds(F.pmod(number(9).cast("long"), F.lit(2_000_000_000)))
    plain = [*[F.reverse(number(at)) for at in (9, 35, 61)], F.date_format(time, "yyyy-MM-dd_HH-mm-ss"),
             F.concat(F.date_format(time, "/yyyy/MM/dd/"), F.substring(number(22), 1, 8))]
    hits = base_hits(F.col("t"))
    rows = staged(rows, {f"__{k}": h for k, h in hits.items()} | {"__runs": regex_hits(F.col("t"), RUN)})
    rows = staged(rows, {"__base": F.concat(*[as_spans(F.col(f"__{k}"), i, k).cast(SPAN_TYPE) for i, k in enumerate(KINDS)])})
    values = F.concat(F.transform("__assign", lambda h: F.regexp_replace(F.regexp_extract(h["hit"], ASSIGN, 1), r"\.", "")),
                      F.transform("__access", lambda h: h["hit"]), F.transform("__hex", lambda h: h["hit"]))
    digits_inside = lambda s: F.rlike(s, F.lit("[0-9]"))
    words = F.array_distinct(F.filter(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0)), lambda w:
                                      ~digits_inside(w) & (F.pmod(F.xxhash64(w), F.lit(32)) == 0)))
    labelled = rows.select(
        F.explode(F.concat(
            F.transform(F.concat(F.array(*digest), F.filter(values, lambda s: digits_inside(s) & (F.length(s) >= 16))),
                        lambda s: F.struct(s.alias("s"), F.lit(1).alias("label"))),
            F.transform(F.concat(words, F.array(*plain), _plain(F.col("__runs"), F.col("__base"))),
                        lambda s: F.struct(s.alias("s"), F.lit(0).alias("label"))))).alias("r")).select("r.*")
    return labelled.distinct().withColumn("held", _held(F.col("s")))


def judged_strings(df: DataFrame, text_col: str, part: float) -> DataFrame:
    """``s``: every plain token (as it is scored: outside base spans) of all rows, but those that taught the models."""
    s = staged(df.select(text_or_empty(F.col(f"`{text_col}`")).alias("t")), {"__tokens": regex_hits(F.col("t"), TOKEN)})
    s = s.filter(F.exists("__tokens", lambda h: F.rlike(h["hit"], F.lit(PLAIN))))
    hits = base_hits(F.col("t"))
    s = staged(s, {"__base": F.concat(*[as_spans(hits[k], i, k).cast(SPAN_TYPE) for i, k in enumerate(KINDS)]),
                   "__taught": _sampled(F.sha2(F.col("t"), 512), part)})
    return (s.select("__taught", F.explode(_plain(F.col("__tokens"), F.col("__base"))).alias("s"))
            .filter(~F.col("__taught") | _held(F.col("s"))).select("s"))


class MarkovRatio:
    """Log-likelihood ratio per character of the random against the ordinary model, and its threshold."""

    def __init__(self, table: list[float], threshold: float):
        self.table, self.threshold = table, threshold

    def score(self, s: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(self.table)), "array<double>")  # constant: folded once by the optimiser
        pairs = _pairs(s)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1))
        return total / F.greatest(F.size(pairs), F.lit(1))


def fit_markov(df: DataFrame, text_col: str = "text", per_label: int = TRAIN_STRINGS,
               false_positives: float = FALSE_POSITIVES) -> MarkovRatio:
    """Fit both first-order models with add-one smoothing; the alphabet bounds the table at 67 x 67 numbers.

    The threshold is halfway between two scores: the one that all but ``false_positives`` of the ordinary strings stay
    under, and the one that all but ``MISSES`` of the held-out random ones pass; never below the first. The first is the
    larger of two quantiles: over the plain tokens of all rows that taught nothing, with their counts, and over the held-out
    ordinary strings.
    """
    part = _sample_share(df, per_label)
    sample = stored(labelled_strings(df, text_col, part))
    counts = (sample.filter(~F.col("held")).select("label", F.explode(_pairs(F.col("s"))).alias("p"))
              .groupBy("label", "p").count().collect())  # at most 2 x 67 x 67 rows
    n = [[1.0] * (_SIZE * _SIZE) for _ in range(2)]
    for r in counts:
        n[r["label"]][r["p"]] += r["count"]
    table = []
    for a in range(_SIZE):
        rows = [n[k][a * _SIZE:(a + 1) * _SIZE] for k in range(2)]
        table += [round(math.log(rows[1][b] / sum(rows[1])) - math.log(rows[0][b] / sum(rows[0])), 6)
                  for b in range(_SIZE)]
    model = MarkovRatio(table, 0.0)
    held = sample.filter(F.col("held") & (F.length("s") >= 8)).select("label", model.score(F.col("s")).alias("x"))
    q = held.agg(*[F.percentile_approx(F.when(F.col("label") == k, F.col("x")), p, 10_000)
                   for k, p in ((0, 1.0 - false_positives), (1, MISSES))]).first()
    judged = judged_strings(df, text_col, part).agg(
        F.percentile_approx(model.score(F.col("s")), 1.0 - false_positives, 10_000)).first()[0]
    low = max((x for x in (q[0], judged) if x is not None), default=None)
    if low is not None:
        model.threshold = low if q[1] is None else max(low, (low + q[1]) / 2)
    return model


def find_secrets(df: DataFrame, text_col: str = "text", per_label: int = TRAIN_STRINGS) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans`` (start, rank, kind, end; code points, end exclusive).

    Base spans are the long enough matches of the fixed patterns and always stay. Every other run of 16 or more
    characters of the alphabet that holds a digit and overlaps no base span is scored by both Markov models, and added
    as ``random`` if its ratio per character passes the threshold. Null and empty texts have no spans. Rows are kept
    one to one, input columns named like a result are replaced, an empty table gives an empty result.
    """
    model = fit_markov(df, text_col, per_label)
    s = staged(df, {"__text": text_or_empty(F.col(f"`{text_col}`"))})
    hits = base_hits(F.col("__text"))
    s = staged(s, {"__base": F.concat(*[as_spans(hits[k], i, k).cast(SPAN_TYPE) for i, k in enumerate(KINDS)]),
                   "__tokens": regex_hits(F.col("__text"), TOKEN)})
    fits = F.filter("__tokens", lambda h: ~F.exists("__base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"]))
                    & (model.score(h["hit"]) > model.threshold))
    added = as_spans(fits, len(KINDS), "random").cast(SPAN_TYPE)
    out = attach(s, {"base_spans": F.array_sort("__base"), "spans": F.array_sort(F.concat("__base", added))})
    return out.drop("__text", "__base", "__tokens")


def redact(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span of ``spans`` in the text by ``mark`` (overlapping spans by one), and drop the span columns."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    merged = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(
                a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))
            .otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    cleaned = F.when(F.size("spans") > 0, merged).otherwise(F.col(f"`{text_col}`"))
    return found.withColumn(text_col, cleaned).drop("spans", "base_spans")
