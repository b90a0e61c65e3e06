"""The training-data queries: each ``opN_<name>`` applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    language_model, mixing, mpeg, neighbours, ngram_join, packing, pii, prefix_trie, quality, suffix_dedup, toxicity, url_rules,
    whitening,
)
from .shared import table


def op1_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return judged.drop("text")


def op2_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op3_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digest(table(spark, sf_dir, "documents"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


ALL = (
    op1_hierarchical_quality, op2_sparse_suffix_dedup, op3_gated_recurrent_lm, op4_best_fit_packing, op5_hilbert_neighbours,
    op6_disclosure_sanitiser, op7_source_mixing, op8_mpeg_audio, op9_ordinal_toxicity, op10_ngram_jaccard_join,
    op11_jacobi_whitening, op12_url_association_rules, op13_conversation_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

WORDS = r"""list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
LOWERED = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def digest_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT)::DOUBLE"


MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
o AS (SELECT *, {digest_sql("'mix:' || doc_id::VARCHAR")} AS h, floor(log2(size + 1.0) * 8)::INT AS grade FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s),
r AS (SELECT *, most / weight AS ratio, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS n FROM w),
c AS (SELECT r.*, most / weight <= ((SELECT sum(source_size) FROM r) - coalesce((SELECT sum(b.most) FROM r b WHERE b.n < r.n), 0)) / ((SELECT sum(weight) FROM r) - coalesce((SELECT sum(b.weight) FROM r b WHERE b.n < r.n), 0)) AS capped FROM r),
l AS (SELECT ((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(most) FROM c WHERE capped), 0)) / (SELECT sum(weight) FROM c WHERE NOT capped) AS level),
t AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE level * weight END AS target FROM c, l),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {digest_sql("CASE WHEN o.source IS NULL THEN 'mix' ELSE 'mix:' || o.source END")} / 4295032832.0 AS start,
      row_number() OVER (PARTITION BY o.source ORDER BY grade, floor(h * 1024 / 4294967296.0), h, doc_id) AS place FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(floor(place * rate + start) - floor((place - 1) * rate + start), 3))::BIGINT AS taken FROM p
"""

NGRAM_JOIN_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWERED} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 85 * (len(a.g) + len(b.g) - k)),
way AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, way.y FROM reach r JOIN way ON way.x = r.b)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(b) AS component_id FROM s JOIN reach ON a = s.doc_id GROUP BY s.doc_id, g
"""

REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS w FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS h FROM d WHERE len(w) >= 50),
p AS (SELECT doc_id, unnest(h) AS win, unnest(range(0, len(h))) AS first FROM h),
g AS (SELECT win, min(doc_id) AS lo, max(doc_id) AS hi FROM p GROUP BY win HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, first, first + 50 AS last, CASE WHEN lo <> doc_id THEN lo ELSE hi END AS other FROM p JOIN g USING (win)),
m AS (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s),
n AS (SELECT *, sum(CASE WHEN reached IS NULL OR first > reached THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM m)
SELECT doc_id, min(first) AS first_word, max(last) AS end_word, max(last) - min(first) AS n_words, min(other) AS other_doc FROM n GROUP BY doc_id, stretch
"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
-- checksum of the decimal digits, a bit at a time
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, (xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT) % 4)::INT AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, least(h, coalesce((SELECT max(place) FROM t WHERE t.conv_id = base), 0)) AS k FROM c),
r AS (
  SELECT k.conv_id, t.place AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.place <= h
  UNION ALL SELECT k.conv_id, t.place - h + k, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.place > h),
p AS (
  SELECT conv_id, d, len({WORDS}) AS words, list([role, text]) OVER (
    PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
z AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
n AS (
  SELECT p.path, p.d, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE z.d = p.d), '')) AS ends
  FROM p JOIN z USING (conv_id) GROUP BY p.path, p.d),
m AS (SELECT p.conv_id AS member, n.conv_id, n.d, n_convs, own, ends FROM p JOIN n ON p.path = n.path),
u AS (
  SELECT b.conv_id, b.d, a.conv_id AS parent FROM m b
  LEFT JOIN m a ON a.member = b.conv_id AND a.d = b.d - 1 WHERE b.member = b.conv_id),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1, 2),
-- the nodes of a subtree: those of its members, each once
s AS (
  SELECT a.conv_id, a.d, count(*) FILTER (WHERE q.n_children IS NULL) AS n_leaves, sum(b.own) AS saved_tokens
  FROM m a JOIN m b ON b.member = a.member AND b.conv_id = b.member AND b.d >= a.d
  LEFT JOIN kids q ON q.conv_id = b.conv_id AND q.d = b.d GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, u.parent AS parent_conv_id, m.n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  ends AS ends_sha256
FROM m JOIN u USING (conv_id, d) JOIN s USING (conv_id, d) LEFT JOIN kids q USING (conv_id, d)
WHERE m.member = m.conv_id
"""

ORACLES: dict[str, str] = {"op2_sparse_suffix_dedup": REPEATS_SQL, "op7_source_mixing": MIXING_SQL, "op10_ngram_jaccard_join": NGRAM_JOIN_SQL, "op13_conversation_trie": TRIE_SQL}
