"""Search, similarity, distribution and map queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import query_terms
from ..functions.vectors import dot, mean_of, unit
from ..operators import entities, learning, metrics, preference, search
from ..sources.tables import DIM, samples, table, verdicts
from .registry import query

DOT = "list_inner_product"


def vocabulary(spark, folder) -> DataFrame:
    """(term, vec): the unit mean of each group."""
    rows = samples(spark, folder).groupBy("grp").agg(mean_of(F.col("vec"), DIM).alias("_m"))
    return rows.select(F.concat(F.lit("group "), F.col("grp")).alias("term"), unit(F.col("_m")).alias("vec"))


def liked(spark, folder) -> DataFrame:
    """Samples with a positive verdict of the profile toxic; one at a time without a sample is of no other sample."""
    v = preference.keep_latest(verdicts(spark, folder)).where("profile = 'toxic' and label = 1")
    return preference.training_set(v, samples(spark, folder)).where("t = at")


def preferred(spark, folder) -> DataFrame:
    """Samples with their preference score."""
    return search.scored(samples(spark, folder), preference.centroid(liked(spark, folder), DIM))


def shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("vec_id", "item_key", "t", F.round("score", 4).alias("score"), *more)


ONE = f"""one AS (SELECT vec AS query FROM s WHERE item_key = 7 ORDER BY abs(t - 17.0), t LIMIT 1),
    h AS (SELECT vec_id, item_key, t, grp, {DOT}(vec, query) AS score FROM s, one WHERE item_key <> 7)"""


@query(f"""WITH {ONE}, c AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS r FROM h)
    SELECT vec_id, item_key, t, round(score, 4) AS score FROM c WHERE r <= 3
    ORDER BY c.score DESC, item_key, t LIMIT 60""", "s")
def knn_by_sample(spark, folder):
    return shown(search.search_by_sample(samples(spark, folder), 7, 17.0))


@query(f"WITH {ONE} SELECT vec_id, item_key, t, round(score, 4) AS score FROM h WHERE score >= 0.1", "s")
def knn_floor_all(spark, folder):
    s = samples(spark, folder)
    return shown(search.search(s, search.vector_at(s, 7, 17.0), None, exclude_key=7, min_score=0.1))


@query(f"""WITH {ONE}, c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, item_key, t) AS r FROM h)
    SELECT vec_id, item_key, t, round(score, 4) AS score, grp FROM c WHERE r <= 2""", "s")
def knn_group_cap(spark, folder):
    s = samples(spark, folder)
    return shown(search.search(s, search.vector_at(s, 7, 17.0), None, per_item=2, per="grp", exclude_key=7), "grp")


@query(f"""WITH pn AS (SELECT a.vec AS x, b.vec AS y FROM voc a, voc b WHERE a.term = 'group 3' AND b.term = 'group 5'),
    d AS (SELECT list_transform(range(1, 65), lambda i: x[i] - y[i]) AS w FROM pn),
    u AS (SELECT list_transform(w, lambda x: x / sqrt({DOT}(w, w))) AS query FROM d),
    h AS (SELECT vec_id, item_key, t, {DOT}(vec, query) AS score FROM s, u)
    SELECT vec_id, item_key, t, round(score, 4) AS score FROM h ORDER BY h.score DESC, item_key, t LIMIT 40""", "s voc")
def text_vector_posneg(spark, folder):
    q = search.posneg_query(vocabulary(spark, folder), "group 3", "group 5")
    return shown(search.search(samples(spark, folder), q, 40))


@query(
    r"""WITH a AS (SELECT doc_id, translate(left(text, 60), 'wWd', '-+ ') AS asked FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, list_filter(string_split_regex(trim(asked), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS tokens FROM a),
    n AS (SELECT *, list_filter(tokens, lambda x: length(x) > 1 AND x[1] = '-') AS minus,
      list_filter(tokens, lambda x: NOT (length(x) > 1 AND x[1] = '-')) AS plus FROM k)
    SELECT doc_id, CASE WHEN len(plus) = 0 AND len(minus) > 0 THEN trim(asked) ELSE array_to_string(
        list_transform(plus, lambda x: CASE WHEN length(x) > 1 AND x[1] = '+' THEN x[2:] ELSE x END), ' ') END AS positive,
      CASE WHEN len(plus) = 0 AND len(minus) > 0 THEN '' ELSE array_to_string(list_transform(minus, lambda x: x[2:]), ' ') END AS negative
    FROM n"""
)
def text_query_parse(spark, folder):
    """The beginning of each text as a query: its w begin negative terms, its W positive ones."""
    asked = F.translate(F.left("text", F.lit(60)), "wWd", "-+ ")
    rows = table(spark, folder, "documents").where("text IS NOT NULL").withColumn("q", query_terms(asked))
    return rows.select("doc_id", "q.positive", "q.negative")


@query(f"""WITH one AS (SELECT vec AS query FROM s WHERE item_key = 0 ORDER BY abs(t), t LIMIT 1),
    h AS (SELECT vec_id, item_key, t, {DOT}(vec, query) AS score FROM s, one WHERE item_key <> 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS r FROM h WHERE score >= 0.3)
    SELECT vec_id, item_key, t, round(score, 4) AS score FROM c WHERE r = 1
    ORDER BY c.score DESC, item_key, t LIMIT 40""", "s")
def near_duplicates(spark, folder):
    return shown(search.duplicates(samples(spark, folder), 0, 0.0, 0.3))


@query(f"SELECT item_key, round(t, 2) AS t, round({DOT}(vec, query), 4) AS score FROM s, q WHERE item_key = 11", "s q")
def item_timeline(spark, folder):
    return search.timeline(samples(spark, folder), 11, preference.centroid(liked(spark, folder), DIM))


@query(f"SELECT a.vec_id, round(max({DOT}(a.vec, b.vec)), 4) AS score FROM s a, s b WHERE b.vec_id < 12 GROUP BY a.vec_id", "s")
def similarity_max(spark, folder):
    s = samples(spark, folder)
    return search.similarity(s, s.where("vec_id < 12")).select("vec_id", F.round("score", 4).alias("score"))


@query(f"SELECT a.vec_id, round(avg({DOT}(a.vec, b.vec)), 4) AS score FROM s a, s b WHERE b.vec_id < 12 GROUP BY a.vec_id", "s")
def similarity_mean(spark, folder):
    s = samples(spark, folder)
    return search.similarity_blocked(s, s.where("vec_id < 12"), "mean").select("vec_id", F.round("score", 4).alias("score"))


@query("""WITH c AS (SELECT seq, v.t AS asked, s.vec_id, s.t, row_number() OVER (PARTITION BY seq
    ORDER BY abs(s.t - (v.t + 3.0)), s.t) AS r FROM v JOIN s USING (item_key) WHERE profile = 'quality')
    SELECT seq AS point_id, asked + 3.0 AS asked, vec_id, t FROM c WHERE r = 1""", "s v")
def asof_nearest(spark, folder):
    points = verdicts(spark, folder).where("profile = 'quality'").select(F.col("seq").alias("point_id"), "item_key", (F.col("t") + 3.0).alias("at"))
    return search.asof(points, samples(spark, folder)).select("point_id", F.col("at").alias("asked"), "vec_id", "t")


@query("""SELECT seq AS point_id, item_key, label, t
    FROM (SELECT v.seq, v.item_key, v.label, s.t, row_number() OVER (PARTITION BY v.seq
    ORDER BY abs(s.t - v.t), s.t) AS r FROM v JOIN s USING (item_key) WHERE profile = 'toxic') WHERE r = 1""", "s v")
def training_set(spark, folder):
    v = preference.keep_latest(verdicts(spark, folder)).where("profile = 'toxic'")
    return preference.training_set(v, samples(spark, folder)).select("point_id", "item_key", "label", "t")


@query("""SELECT pct, round(cutoff, 6) AS cutoff FROM (SELECT unnest([50, 75, 90, 95, 99]) AS pct,
    unnest(quantile_cont(score, [0.5, 0.75, 0.9, 0.95, 0.99])) AS cutoff FROM p)""", "p")
def metrics_percentiles(spark, folder):
    return metrics.percentiles(preferred(spark, folder)).select("pct", F.round("cutoff", 6).alias("cutoff"))


@query("""WITH c AS (SELECT unnest([50, 75, 90, 95, 99]) AS pct, unnest(quantile_cont(score, [0.5, 0.75, 0.9, 0.95,
    0.99])) AS cutoff FROM p), i AS (SELECT item_key, max(score) AS score FROM p GROUP BY item_key)
    SELECT pct, round(cutoff, 4) AS cutoff, (SELECT count(*) FROM p
    WHERE p.score >= cutoff) AS moments, (SELECT count(*) FROM i WHERE i.score >= cutoff) AS items FROM c""", "p")
def metrics_bands(spark, folder):
    return metrics.bands(preferred(spark, folder))


def _histogram(bins: int, of: str) -> str:
    return f"WITH x AS ({of}), g AS (SELECT min(score) AS lo, max(score) AS hi FROM x), n AS (SELECT least(floor((score - lo) / (hi - lo) * {bins})::INT, {bins - 1}) AS bin, count(*) AS n FROM x, g GROUP BY 1) SELECT k::INT AS bin, round(lo + k * ((hi - lo) / {bins}), 6) AS lo, round(lo + (k + 1) * ((hi - lo) / {bins}), 6) AS hi, coalesce(n, 0) AS n FROM g, range(0, {bins}) r(k) LEFT JOIN n ON n.bin = k"


@query(_histogram(24, "SELECT score FROM p"), "p")
def metrics_histogram(spark, folder):
    return metrics.histogram(preferred(spark, folder)).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("""WITH g AS (SELECT min(score) AS lo, max(score) AS hi FROM p), c AS (SELECT k::INT AS step, CASE
    WHEN k = 100 THEN hi ELSE lo + k * (hi - lo) / 100 END AS cutoff FROM g, range(0, 101) r(k)),
    i AS (SELECT item_key, max(score) AS score FROM p GROUP BY item_key)
    SELECT step, round(cutoff, 6) AS cutoff, (SELECT count(*) FROM p
    WHERE p.score >= cutoff) AS moments, (SELECT count(*) FROM i WHERE i.score >= cutoff) AS items FROM c""", "p")
def metrics_cdf(spark, folder):
    out = metrics.survival(preferred(spark, folder))
    return out.select("step", F.round("cutoff", 6).alias("cutoff"), "moments", "items")


@query("""WITH i AS (SELECT item_key, max(score) AS score FROM p GROUP BY item_key)
    SELECT 0.1::DOUBLE AS value, count(*) FILTER (score >= 0.1) AS moments, (SELECT count(*) FROM i
    WHERE score >= 0.1) AS items, round(count(*) FILTER (score < 0.1) / count(*) * 100, 1) AS percentile FROM p""", "p")
def metrics_threshold(spark, folder):
    return metrics.threshold_report(preferred(spark, folder), 0.1)


@query("""SELECT round(min(score), 6) AS low, round(avg(score), 6) AS mean, round(max(score), 6) AS high, count(*) AS n
    FROM p""", "p")
def metrics_spread(spark, folder):
    d = metrics.spread(preferred(spark, folder))
    return d.select(*[F.round(c, 6).alias(c) for c in ("low", "mean", "high")], "n")


@query("""SELECT round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90,
    round(quantile_cont(score, 0.97), 6) AS p97, round(quantile_cont(score, 0.99), 6) AS p99, round(avg((score >=
    0.15)::INT), 6) AS above FROM p""", "p")
def calibration(spark, folder):
    c = metrics.calibration(preferred(spark, folder), 0.15)
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


CENTRES = f"""u AS (SELECT k, list(a ORDER BY i) AS w FROM (SELECT item_key AS k, i, avg(vec[i]) AS a
    FROM s, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY k),
    c AS (SELECT k AS item_key, list_transform(w, lambda x: x / sqrt({DOT}(w, w))) AS centre FROM u)"""


@query(f"""WITH {CENTRES} SELECT item_key, round(centre[1], 5) AS v1, round(centre[64], 5) AS v64, round({DOT}(centre,
    query), 5) AS score FROM c, q""", "s q")
def item_centroid(spark, folder):
    c = entities.item_centroids(samples(spark, folder)).crossJoin(F.broadcast(preference.centroid(liked(spark, folder), DIM)))
    return c.select("item_key", F.round(F.col("vec")[0], 5).alias("v1"), F.round(F.col("vec")[63], 5).alias("v64"), F.round(dot("vec", "query"), 5).alias("score"))


@query(f"""WITH {CENTRES}, h AS (SELECT item_key, t, {DOT}(vec, centre) AS score FROM s JOIN c USING (item_key)),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS n FROM h)
    SELECT item_key, t, round(score, 4) AS score FROM r WHERE n = 1""", "s")
def item_representative(spark, folder):
    s = samples(spark, folder)
    return entities.representatives(s, entities.item_centroids(s)).select("item_key", "t", F.round("score", 4).alias("score"))


def _terms(key: str, k: int, floor: str = "") -> str:
    return f"WITH h AS (SELECT {key}, term, max({DOT}(s.vec, voc.vec)) AS score FROM s, voc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, term) AS rank FROM h {floor}) SELECT {key}, term, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= {k}"


@query(_terms("vec_id", 6), "s voc")
def classify_sample(spark, folder):
    out = search.top_terms(samples(spark, folder).select("vec_id", "vec"), vocabulary(spark, folder), ["vec_id"], 6)
    return out.select("vec_id", "term", F.round("score", 4).alias("score"), "rank")


@query(_terms("item_key", 5, "WHERE score >= 0.2"), "s voc")
def auto_tag(spark, folder):
    out = search.top_terms(samples(spark, folder).select("item_key", "vec"), vocabulary(spark, folder), ["item_key"], 5, 0.2)
    return out.select("item_key", "term", F.round("score", 4).alias("score"), "rank")


@query(f"SELECT term, round({DOT}(vec, query), 4) AS score FROM voc, q ORDER BY {DOT}(vec, query) DESC, term LIMIT 10", "voc q")
def pref_words(spark, folder):
    rows = preference.centroid(liked(spark, folder), DIM, "vec").withColumn("who", F.lit(1))
    return search.top_terms(rows, vocabulary(spark, folder), ["who"], 10).select("term", F.round("score", 4).alias("score"))


@query("""WITH b AS (SELECT vec_id, item_key, t, score FROM p ORDER BY score DESC, item_key, t LIMIT 30)
    SELECT vec_id, round(score, 4) AS score, start, start + 20 AS \"end\", 20.0::DOUBLE AS duration, n
    FROM (SELECT b.*, b.t AS start, i.n FROM b LEFT JOIN (SELECT vec_id // 10 AS item_key, count(*) AS n
    FROM embeddings GROUP BY 1) i USING (item_key))""", "p")
def enriched_clips(spark, folder):
    from ..sources.stores import sample_counts

    hits = search.enrich(preferred(spark, folder), sample_counts(samples(spark, folder)), "item_key", 30)
    return hits.select("vec_id", F.round("score", 4).alias("score"), F.col("t").alias("start"), (F.col("t") + 20).alias("end"), F.lit(20.0).alias("duration"), "n")


@query("SELECT item_key, count(*) AS n FROM s GROUP BY item_key", "s")
def cache_counts(spark, folder):
    from ..sources.stores import sample_counts

    return sample_counts(samples(spark, folder))


@query("""SELECT item_key FROM (SELECT vec_id // 10 AS item_key, min(CASE WHEN vec_id % 97 = 0 THEN NULL
    ELSE 8.0 + (vec_id // 10) % 2 END) AS lo, count(CASE WHEN vec_id % 97 = 0 THEN NULL
    ELSE 1 END) AS n, count(*) AS a FROM embeddings GROUP BY 1) WHERE n = a AND lo = 8.0""")
def cache_up_to_date(spark, folder):
    from ..sources.stores import up_to_date

    s = samples(spark, folder).withColumn("signature", F.when(F.col("vec_id") % 97 != 0, 8.0 + F.col("item_key") % 2))
    return up_to_date(s, 8.0)


@query()
def map_pca(spark, folder):
    points = learning.project(entities.item_centroids(samples(spark, folder)))
    return points.select("item_key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def map_clusters(spark, folder):
    points = learning.cluster(learning.project(entities.item_centroids(samples(spark, folder))))
    return learning.cluster_summary(points, vocabulary(spark, folder))


@query()
def pref_logreg(spark, folder):
    v = preference.keep_latest(verdicts(spark, folder)).where("profile = 'toxic'")
    s = samples(spark, folder)
    model = learning.fit_logistic(preference.training_set(v, s))
    return learning.predict(model, s).select("vec_id", F.round("p", 4).alias("p"))


@query()
def pref_mlp(spark, folder):
    v = preference.keep_latest(verdicts(spark, folder)).where("profile = 'toxic'")
    s = samples(spark, folder)
    model = learning.fit_perceptron(preference.training_set(v, s), 16, steps=40)
    return learning.predict(model, s).select("vec_id", F.round("p", 4).alias("p"))


@query()
def pref_cv_auc(spark, folder):
    v = preference.keep_latest(verdicts(spark, folder)).where("profile = 'toxic'")
    auc = learning.cv_auc(preference.training_set(v, samples(spark, folder)))
    return spark.createDataFrame([(float(auc),)], "auc double")


@query()
def map_neighbours(spark, folder):
    """The map points in a rectangle, and their distance to its middle."""
    points = learning.project(entities.item_centroids(samples(spark, folder))).where("x between 0.25 and 0.75 and y between 0.25 and 0.75")
    return points.select("item_key", F.round(F.hypot(F.col("x") - 0.5, F.col("y") - 0.5), 4).alias("distance"))


@query(f"SELECT count(*) AS n, round(sum({DOT}(vec, query)), 3) AS total FROM s, q", "s q")
def preference_total(spark, folder):
    return preferred(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"))
