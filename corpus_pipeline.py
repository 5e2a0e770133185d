"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import decontam, langid, mixing, ngram_join, secrets
from clusterlens.llm.common import n_words, stored, text_or_empty
from clusterlens.llm.queries import MIX_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Share of a document's letters that must be in its main language. Undetermined documents go in any case.
MIN_LANGUAGE_SHARE = 0.3


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; ``lang`` becomes the predicted one. Texts without a letter go."""
    out = langid.identify(docs.select(*COLUMNS))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)) \
        .withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id (null ids last), then the smallest text hash.

    Rows whose text has no word are a class for each id and text.
    """
    # id and text hash together name a document, so that repeated and null ids keep their class
    named = docs.select(*COLUMNS).withColumn("__h", F.sha2(text_or_empty(F.col("text")), 256))
    found = ngram_join.near_duplicates(named.select(F.struct("doc_id", "__h").alias("doc_id"), "text"))
    found = stored(found.select("doc_id.doc_id", "doc_id.__h", "class_key").groupBy("doc_id", "__h", "class_key")
                   .agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__h"))
    first = found.filter(F.col("class_key").isNotNull()).groupBy("class_key").agg(
        F.min_by(F.struct("doc_id", "__h", "n"), order).alias("r")).select("r.*")
    keep = first.unionByName(found.filter(F.col("class_key").isNull()).select("doc_id", "__h", "n"))
    same = named["doc_id"].eqNullSafe(keep["doc_id"]) & (named["__h"] == keep["__h"])
    left = named.join(keep, same).select(*[named[c] for c in COLUMNS], named["__h"], "n")
    once = left.filter(F.col("n") == 1).select(*COLUMNS)
    # rows with the same id and text are rare: only these are grouped
    again = left.filter(F.col("n") > 1).groupBy("doc_id", "__h").agg(
        F.min_by(F.struct(*COLUMNS[1:]), F.struct("source", "lang", "n_chars", "text")).alias("r")).select("doc_id", "r.*")
    return once.unionByName(again.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contract does not call contaminated; every row is judged by its own text.

    The verdict follows from the text alone, so a digest of the text names the document.
    """
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    digest = F.unhex(F.md5(text_or_empty(F.col("text"))))
    found = decontam.find_contamination(docs.select(digest.alias("digest"), "text"), items, id_col="digest")
    bad = stored(found.filter(decontam.contaminated()).select(F.col("doc_id").alias("digest")).distinct())
    kept = docs.select(*COLUMNS)
    return kept.join(bad, digest == bad["digest"], "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; ``n_chars`` follows the text."""
    out = secrets.redact(secrets.find_secrets(docs.select(*COLUMNS)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: one row per document."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(sized, MIX_WEIGHTS)


STAGES = [("language_id", keep_identified), ("near_duplicates", keep_one_of_each),
          ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("mixing", mix_sources)]

#: Learned models and draws are not SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
