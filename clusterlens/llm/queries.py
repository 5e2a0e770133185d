"""The registered queries of this subpackage: thin, each through its operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontam, langid, licenses, merkle, mixing, ngram_join, pii, quality, secrets, suffix_dedup, topk,
               url_filter)
from .common import n_words

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_pii")
def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.digest_columns(pii.find_pii(docs), pii.KINDS)
    return out.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


@register("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


@register("op3_secrets")
def op3_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.digest_columns(secrets.find_secrets(docs), secrets.KINDS)
    return out.select("doc_id", *[f"n_{k}" for k in secrets.KINDS], "base_sha256", "spans")


@register("op4_quality")
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_filter(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op5_licenses")
def op5_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.summary(licenses.find_licenses(docs).drop("text")).select(
        "doc_id", "license", "coverage", "n_spans", "spans")


#: Fixed weights of the contract.
MIX_WEIGHTS = (3.0, 1.0, 2.0)


@register("op6_mixing")
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(docs, MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


_DECONTAM_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
doc_wins AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc_words, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT r, k, n, item_id FROM doc_wins JOIN wins USING (n, win)),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""


@register("op7_decontamination", _DECONTAM_SQL)
def op7_decontamination(spark, sf_dir):
    out = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      decontam.contaminated().alias("contaminated"))


_SUFFIX_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
pieces AS (SELECT doc_id, 500 * p AS base, substr(b, 1000 * p + 1, 1198) AS piece
  FROM (SELECT doc_id, b, unnest(range(0, (length(b) // 2 - 100) // 500 + 1)) AS p FROM docs WHERE length(b) >= 200)),
starts AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS FIRST, s) > 1 AS later
  FROM (SELECT doc_id, base + o AS s, substr(piece, 2 * o + 1, 200) AS x
        FROM (SELECT doc_id, base, piece, unnest(range(0, length(piece) // 2 - 99)) AS o FROM pieces))),
runs AS (
  SELECT doc_id, s, s > coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) + 100 AS fresh,
         coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) AS before
  FROM starts WHERE later),
spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS z
  FROM (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM runs) GROUP BY doc_id, g),
kept AS (
  SELECT d.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(b, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(b), 2 * max(z) + 1) AS rest
  FROM (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans) s
       JOIN docs d ON d.doc_id IS NOT DISTINCT FROM s.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(b) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, b))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""


@register("op8_suffix_dedup", _SUFFIX_SQL)
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


_JOIN_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
         lambda k: array_to_string(w[k:k + 4], ' ')))) AS g FROM docs WHERE len(w) > 0),
sets AS (SELECT min(doc_id) AS rep, g, len(g) AS n FROM grams GROUP BY g),
gram AS (SELECT rep, n, unnest(g) AS x FROM sets),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM gram a JOIN gram b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id,
       (SELECT count(*) FROM links l WHERE l.a = s.rep) AS n_links
FROM docs d LEFT JOIN grams g USING (doc_id) LEFT JOIN sets s ON s.g = g.g LEFT JOIN class c ON c.rep = s.rep
"""


@register("op9_ngram_join", _JOIN_SQL)
def op9_ngram_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links")


_URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         contains(coalesce(url, ''), '://') AS has
  FROM pages),
rules(rhost, rpath, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM parts WHERE has) p JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.action
            WHEN p.has AND (regexp_matches(p.host || p.path, '^([^/]*[.-])?(ads|adserver|track|casino|porn)([.-][^/]*)?(/|$)')
                 OR regexp_matches(p.host || p.path, '/cart/(checkout|add)(/|$)')) THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""


@register("op10_url_filter", _URL_SQL)
def op10_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_urls(pages, url_filter.BASE_RULES + url_filter.GENERAL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


_TOPK_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@register("op11_topk_search", _TOPK_SQL)
def op11_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)
  GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
         (c.a::HUGEINT * c.a::HUGEINT * 1000000::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_of AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE k = 3)
  GROUP BY lang, phrase),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_of i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE rank <= 2000
"""


@register("op12_collocations", _PHRASE_SQL)
def op12_collocations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(docs).select(F.col("group").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


_MERKLE_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
         || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
         coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail,
         coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
                    lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))),
                4294967295) % 3 = 0, false) AS tampered
  FROM documents),
leaves AS (
  SELECT *, sha256(head || tail) AS leaf,
         CASE WHEN tampered THEN sha256(head || translate(tail, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
              ELSE sha256(head || tail) END AS begin
  FROM raw),
placed AS (
  SELECT r, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS m, leaf AS digest FROM leaves),
tree AS (
  SELECT lang, 0 AS level, pos, m, digest FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, any_value((m + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE m > 1 GROUP BY lang, level, pos // 8),
subroots AS (SELECT lang, digest, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m
             FROM tree WHERE m = 1),
over AS (
  SELECT 0 AS level, pos, m, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, any_value((m + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE m > 1
  GROUP BY level, pos // 8),
nodes AS (
  SELECT t.lang, t.level, t.pos, t.digest, false AS high FROM tree t WHERE m > 1
  UNION ALL
  SELECT s.lang, s.height + o.level, o.pos, o.digest, true FROM over o, (SELECT lang, height FROM subroots) s WHERE o.m > 1),
own AS (
  SELECT p.r, p.lang, l.level, p.pos // (8 ** l.level)::BIGINT AS pos, false AS high
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM tree WHERE m > 1) l ON p.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT p.r, p.lang, s.height + l.level, s.pos // (8 ** l.level)::BIGINT, true
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, (SELECT DISTINCT level FROM over WHERE m > 1) l),
steps AS (
  SELECT o.r, o.level, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < o.pos), '') AS l,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > o.pos), '') AS g
  FROM own o JOIN nodes n ON o.lang IS NOT DISTINCT FROM n.lang AND o.level = n.level AND o.high = n.high AND o.pos // 8 = n.pos // 8
  GROUP BY o.r, o.level),
proofs AS (SELECT r, string_agg(l || g, '' ORDER BY level) AS proof, list(l ORDER BY level) AS ls, list(g ORDER BY level) AS gs FROM steps GROUP BY r),
folds(r, k, digest) AS (
  SELECT r, 1, begin FROM leaves
  UNION ALL
  SELECT f.r, k + 1, sha256(p.ls[k] || f.digest || p.gs[k]) FROM folds f JOIN proofs p USING (r) WHERE k <= len(p.ls))
SELECT d.doc_id, d.leaf, s.digest AS subroot, (SELECT digest FROM over WHERE m = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = (SELECT digest FROM over WHERE m = 1) AS verified
FROM leaves d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang LEFT JOIN proofs p USING (r)
JOIN (SELECT r, max_by(digest, k) AS digest FROM folds GROUP BY r) f USING (r)
"""


@register("op13_merkle", _MERKLE_SQL)
def op13_merkle(spark, sf_dir):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    manifest = merkle.build_manifest(table(spark, sf_dir, "documents").select(*columns), columns, "lang", "doc_id",
                                     altered={"text": merkle.lowered()}, where=merkle.tampered())
    return merkle.verify(manifest)
