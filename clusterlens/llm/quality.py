"""Quality rules: a short-circuit cascade whose order comes from measured cost and selectivity on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, attach, staged, text_or_empty

#: Rows on which cost and selectivity are estimated, at most about so many.
SAMPLE_ROWS = 2000
#: Runs of a rule over the sample.
ROUNDS = 3

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+", -1), lambda w: F.length(w) > 0)


@dataclass(frozen=True)
class Rule:
    """A rule rejects a document where ``fails`` is true; it may use the base columns and the text."""
    name: str
    fails: Callable[[Column], Column]


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))


#: Words of a block in which variety is measured, so that it does not fall with the length of a text.
VARIETY_BLOCK = 1000
#: Characters of scripts that are written without spaces: their runs say nothing about the length of words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"


def _too_long(t: Column) -> Column:
    """Words of more than 20 characters on average, those of scripts without spaces left out."""
    spaced = F.col("word_chars") - F.length(F.regexp_replace(t, f"[^{_UNSPACED}]++", ""))
    return (_share(F.col("word_chars"), F.col("n_words")) > 20.0) & (_share(spaced, F.col("n_words")) > 20.0)


def _variety(t: Column) -> Column:
    """Mean share of distinct words over all blocks of the text."""
    numbered = F.transform(words_of(t), lambda w, i: F.xxhash64(w, F.floor(i / VARIETY_BLOCK)))
    return _share(F.size(F.array_distinct(numbered)), F.col("n_words"))


#: Rules of the cascade. ``text`` is the document's text; the base columns are at hand by name.
RULES = [
    Rule("mean_word_length", lambda t: (_share(F.col("word_chars"), F.col("n_words")) < 2.0) | _too_long(t)),
    Rule("symbol_share", lambda t: _share(F.col("n_symbols"), F.col("n_words")) > 0.5),
    Rule("duplicate_lines", lambda t: _share(F.col("n_dup_lines"), F.size(F.split(t, "\n", -1))) > 0.5),
    Rule("letter_share", lambda t: _share(F.length(F.regexp_replace(t, r"[^\p{L}]++", "")), F.col("word_chars")) < 0.5),
    Rule("distinct_words", lambda t: _variety(t) < 0.05),
]


def _unit(n: Column) -> Column:
    """Power of two above ``n``: the low bits of a packed window, which hold its position."""
    return F.pow(F.lit(2.0), F.length(F.bin(n))).cast("long")


def base_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text (null: empty)."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    s = staged(staged(df, {"__text": text}), {"__words": words_of(F.col("__text"))})
    s = staged(s, {"__win": F.transform(
        F.slice(F.col("__words"), 1, F.greatest(F.size("__words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))})
    # One long per window holds its hash in the high bits and its position in the low ones (as many as the text needs),
    # so one primitive sort brings equal windows together in text order. Texts that repeat no window skip the sort.
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    s = staged(s, {"__unit": _unit(F.size("__win"))})
    packed = F.sort_array(F.transform("__win", lambda h, i: h - F.pmod(h, F.col("__unit")) + i))
    s = staged(s, {"__packed": F.when(repeats, packed)})
    key = lambda v: v - F.pmod(v, F.col("__unit"))
    whole = lambda v: F.get("__win", F.pmod(v, F.col("__unit")).cast("int"))
    # neighbours that agree in the high bits only: rare, and then the whole hashes are sorted instead
    clash = F.size(F.filter("__packed", lambda v, i: (key(v) == key(F.get("__packed", i + 1)))
                            & (whole(v) != whole(F.get("__packed", i + 1))))) > 0
    s = staged(s, {"__exact": F.when(clash, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))))})
    twice = F.filter("__packed", lambda v, i: (key(v) == key(F.get("__packed", i - 1)))
                     | (key(v) == key(F.get("__packed", i + 1))))
    exactly = F.filter("__exact", lambda v, i: (v["h"] == F.get("__exact", i - 1)["h"]) | (v["h"] == F.get("__exact", i + 1)["h"]))
    s = staged(s, {"__twice": F.sort_array(F.when(F.col("__exact").isNull(), F.transform(twice, lambda v: F.pmod(v, F.col("__unit"))))
                                           .otherwise(F.transform(exactly, lambda v: v["i"])))})
    covered = F.aggregate(
        "__twice", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))
    s = staged(s, {"__lines": lines})
    out = attach(s, {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate("__text", " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))})
    return out.drop("__text", "__words", "__win", "__unit", "__packed", "__exact", "__twice", "__lines")


def base_failed() -> Column:
    """Fixed base rule: fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def order_rules(df: DataFrame, rules: list[Rule], text_col: str, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost: each runs alone over a cached sample; seconds above an empty pass are its cost.

    A time is the least of ROUNDS runs, so that what else the machines do does not count.
    """
    keep = min(1.0, sample_rows / max(df.select().count(), 1))
    text = text_or_empty(F.col(f"`{text_col}`"))
    some = df.select(F.col(f"`{text_col}`")).filter(
        F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    sample = base_columns(some, text_col).cache()
    try:
        n = max(sample.count(), 1)

        def run(cond):
            took = []
            for _ in range(ROUNDS):
                t0 = time.perf_counter()
                hits = sample.agg(F.count_if(cond)).first()[0]
                took.append(time.perf_counter() - t0)
            return min(took), hits

        floor, _ = run(F.lit(False))
        scored = []
        for r in rules:
            cost, hits = run(F.coalesce(r.fails(text), F.lit(False)))
            scored.append((hits / n / max(cost - floor, 1e-4), r))
    finally:
        sample.unpersist()
    return [r for _, r in sorted(scored, key=lambda x: -x[0])]


def cascade(rules: list[Rule], text: Column) -> Column:
    """Name of the first rule that fails, null if none does; later rules are not evaluated."""
    out = None
    for r in rules:
        cond = F.coalesce(r.fails(text), F.lit(False))
        out = F.when(cond, F.lit(r.name)) if out is None else out.when(cond, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def quality_filter(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with the base columns, ``base_failed``, ``rejected_by`` and ``kept``.

    ``kept`` is false where the base rule fails (``rejected_by`` is then ``base``) or any rule of the cascade rejects.
    The order of the rules decides only which one is named and how much is computed, never ``kept``. Null and empty
    texts have zero counts and fail the base rule. Rows are kept one to one; input columns named like a result are
    replaced; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    base = base_columns(df, text_col)
    ordered = order_rules(df, rules, text_col, sample_rows)
    text = text_or_empty(F.col(f"`{text_col}`"))
    first = F.when(base_failed(), F.lit("base")).otherwise(cascade(ordered, text))
    out = attach(base, {"base_failed": base_failed(), "rejected_by": first})
    return attach(out, {"kept": F.col("rejected_by").isNull()})
