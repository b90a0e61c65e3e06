"""Preference, board, entity and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.vectors import dot, unit
from ..operators import catalog, entities, metrics, preference, sampling, search
from ..operators.places import numbered
from ..sources.tables import DIM, bridge, by_item, markers, samples, table, verdicts
from .registry import chance, query
from .search import preferred, shown, vocabulary

NOW = 1_706_745_600.0  # fixed, so results repeat


def timed_verdicts(spark, folder):
    return verdicts(spark, folder).withColumn("ts", F.lit(NOW) - F.col("seq") * 3600.0)


VT = "WITH vt AS (SELECT *, 1706745600.0::DOUBLE - seq * 3600.0 AS ts FROM v)"


@query("""WITH d AS (SELECT seq, item_key, t, label, profile FROM v UNION ALL
    SELECT seq + 100000, item_key, t + 0.001, 1 - label, profile FROM v WHERE seq % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_key, round(t, 2), profile ORDER BY seq DESC) AS n FROM d)
    SELECT seq, item_key, t, label, profile FROM r WHERE n = 1""", "v")
def verdict_upsert(spark, folder):
    v = verdicts(spark, folder)
    again = v.where("seq % 5 = 0").select((F.col("seq") + 100000).alias("seq"), "item_key", (F.col("t") + 0.001).alias("t"), (1 - F.col("label")).alias("label"), "profile")
    return preference.keep_latest(v.unionByName(again))


@query("""SELECT profile, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM v
    GROUP BY profile""", "v")
def verdict_counts(spark, folder):
    return preference.verdict_counts(verdicts(spark, folder))


@query("SELECT DISTINCT profile FROM v", "v")
def verdict_profiles(spark, folder):
    return verdicts(spark, folder).select("profile").distinct().orderBy("profile")


@query(f"{VT} SELECT seq, profile FROM vt WHERE NOT (profile = 'toxic' AND ts >= 1706745600.0 - 60 * 3000)", "v")
def verdict_recent_delete(spark, folder):
    return preference.delete_recent(timed_verdicts(spark, folder), NOW, 3000, "toxic").select("seq", "profile")


@query(f"""{VT}, k AS (SELECT min(ts) AS old FROM vt WHERE ts > 0)
    SELECT seq, profile, round(greatest(pow(0.5, (1706745600.0 - CASE WHEN seq % 7 = 0 THEN old
    ELSE ts END) / (86400.0 * 9)), 0.05), 6) AS weight FROM vt, k""", "v")
def recency_weights(spark, folder):
    v = timed_verdicts(spark, folder)
    old = v.withColumn("ts", F.when(F.col("seq") % 7 == 0, F.when(F.col("ts") == -1, F.col("ts")).otherwise(0.0)).otherwise(F.col("ts")))
    oldest = v.where("ts > 0").agg(F.min("ts").alias("_o"))
    out = old.crossJoin(F.broadcast(oldest)).withColumn("weight", scalars.recency_weight(F.col("ts"), F.lit(NOW), F.col("_o"), 9.0))
    return out.select("seq", "profile", F.round("weight", 6).alias("weight"))


SOURCES = """WITH u AS (SELECT 0 AS part, marker_id AS id, item_key % 50 AS item_key, (marker_id % 80)::DOUBLE AS at_ FROM m
    UNION ALL SELECT 1, seq, item_key, t FROM v WHERE profile = 'toxic' AND label = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_key, round(at_, 1) ORDER BY part, id) AS n FROM u),
    a AS (SELECT part, id, s.vec_id, s.vec, row_number() OVER (PARTITION BY part, id
    ORDER BY abs(s.t - at_), s.t) AS r FROM o JOIN s USING (item_key) WHERE n = 1),
    src AS (SELECT part, id, vec_id, vec FROM a WHERE r = 1)"""


def sources(spark, folder):
    m = markers(spark, folder).select("marker_id", (F.col("item_key") % 50).alias("item_key"), (F.col("marker_id") % 80).cast("double").alias("start"))
    return preference.loved_sources(m, verdicts(spark, folder).where("profile = 'toxic'"), samples(spark, folder))


@query(f"{SOURCES} SELECT part, id, vec_id FROM src", "s v m")
def loved_sources(spark, folder):
    return sources(spark, folder).select("part", "id", "vec_id")


def _centre(of: str) -> str:
    return f"c AS (SELECT list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS query FROM (SELECT list(a ORDER BY i) AS w FROM (SELECT i, avg(vec[i]) AS a FROM {of}, range(1, 65) r(i) GROUP BY i)))"


@query(f"{SOURCES}, {_centre('src')} SELECT i::INT AS i, round(query[i], 5) AS x FROM c, range(1, 65) r(i)", "s v m")
def pref_centroid(spark, folder):
    c = preference.centroid(sources(spark, folder), DIM)
    return c.select(F.posexplode("query").alias("i", "x")).select((F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


@query(f"""{SOURCES}, rec AS (SELECT * FROM src ORDER BY part DESC, id DESC LIMIT 15), {_centre('rec')}
    SELECT vec_id, round(list_inner_product(vec, query), 4) AS score FROM s, c""", "s v m")
def pref_recent(spark, folder):
    c = preference.centroid(preference.recent(sources(spark, folder), 15), DIM)
    return search.scored(samples(spark, folder), c).select("vec_id", F.round("score", 4).alias("score"))


@query(f"""{SOURCES}, rec AS (SELECT * FROM src ORDER BY part DESC, id DESC LIMIT 20),
    n AS (SELECT list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS mode FROM rec)
    SELECT vec_id, round(max(list_inner_product(vec, mode)), 4) AS score FROM s, n GROUP BY vec_id""", "s v m")
def pref_modes_score(spark, folder):
    out = preference.mode_scores(samples(spark, folder), preference.recent(sources(spark, folder), 20))
    return out.select("vec_id", F.round("score", 4).alias("score"))


UNIVERSE = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS n FROM p),
    un AS (SELECT vec_id, item_key, t, score, row_number() OVER (ORDER BY score DESC, item_key, t) - 1 AS rank
    FROM r WHERE n <= 4)"""


def pool(spark, folder):
    return preference.ranked_widely(preference.universe(preferred(spark, folder), 4))


@query(f"{UNIVERSE} SELECT vec_id, item_key, t, round(score, 4) AS score, rank::INT AS rank FROM un", "p")
def board_universe(spark, folder):
    return shown(pool(spark, folder), "rank")


@query(f"""{UNIVERSE} SELECT vec_id, item_key, t, round(score, 4) AS score FROM un WHERE score >= 0.05
    ORDER BY {chance('vec_id', 'board')}, vec_id LIMIT 25""", "p")
def board_floor_uniform(spark, folder):
    rows = pool(spark, folder).where("score >= 0.05")
    return shown(sampling.uniform_sample(rows, "vec_id", 25, "board"))


@query(f"""{UNIVERSE}, n AS (SELECT greatest(count(*) / 4.0, 30, 200)::DOUBLE AS heat FROM un)
    SELECT vec_id, item_key, t, round(score, 4) AS score FROM un, n
    ORDER BY -ln({chance('vec_id', 'ranked')}) / exp(-rank / heat), vec_id LIMIT 30""", "p")
def board_rank_weighted(spark, folder):
    return shown(sampling.rank_weighted_sample(pool(spark, folder), "vec_id", 30, "ranked"))


@query(f"""{UNIVERSE} SELECT (SELECT count(*) FROM un WHERE score >= 0.0) AS moments, (SELECT count(DISTINCT item_key)
    FROM un WHERE score >= 0.0) AS items, (SELECT count(*) FROM un
    WHERE score >= 0.0 AND item_key % 3 <> 0) AS after_exclude""", "p")
def board_coverage(spark, folder):
    rows = preference.universe(preferred(spark, folder), 4).where("score >= 0")
    seen = samples(spark, folder).where("item_key % 3 = 0").select("item_key").distinct()
    left = preference.unseen(rows, seen).agg(F.count(F.lit(1)).alias("after_exclude"))
    return rows.agg(F.count(F.lit(1)).alias("moments"), F.countDistinct("item_key").alias("items")).crossJoin(F.broadcast(left))


@query(f"""WITH t AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, item_key, t) - 1 AS rank FROM p
    ORDER BY score DESC, item_key, t LIMIT 60)
    SELECT vec_id, row_number() OVER (ORDER BY -ln({chance('vec_id', 'feed')}) / exp(-rank / 60.0), vec_id)::INT AS
    place FROM t""", "p")
def feed_shuffle(spark, folder):
    top = preferred(spark, folder).orderBy(*search.best_first()).limit(60)
    return sampling.rank_weighted_shuffle(preference.ranked(top), "vec_id", 60, "feed").select("vec_id", "place")


@query(f"""SELECT vec_id, round(pow({chance('vec_id', 'client')}, 1 / greatest(score, 0.05)), 6) AS draw FROM p
    WHERE score > 0.1""", "p")
def weighted_draw(spark, folder):
    return sampling.score_weighted_shuffle(preferred(spark, folder).where("score > 0.1"), "vec_id", "client").select("vec_id", F.round("draw", 6).alias("draw"))


@query("""SELECT vec_id, item_key, t, round(score, 4) AS score FROM p WHERE item_key NOT IN (SELECT item_key FROM v
    WHERE seq % 4 = 0) ORDER BY p.score DESC, item_key, t LIMIT 40""", "p v")
def feed_exclude(spark, folder):
    seen = verdicts(spark, folder).where("seq % 4 = 0").select("item_key").distinct()
    return shown(preference.unseen(preferred(spark, folder), seen).orderBy(*search.best_first()).limit(40))


@query("""WITH x AS (SELECT vec_id, score, list_inner_product(vec, (SELECT vec FROM s WHERE vec_id = 3)) AS rel FROM p),
    g AS (SELECT min(rel) AS lo, max(rel) AS hi FROM x) SELECT vec_id, round(0.8 * score + 0.2 * CASE
    WHEN hi > lo THEN (rel - lo) / (hi - lo) ELSE 1 END, 4) AS blend FROM x, g""", "p")
def rerank_blend(spark, folder):
    one = samples(spark, folder).where("vec_id = 3").select(F.col("vec").alias("query"))
    rows = search.scored(preferred(spark, folder).withColumnRenamed("score", "pref"), one, "rel")
    return preference.rerank(rows, "pref", "rel").select("vec_id", F.round("blend", 4).alias("blend"))


def mmr_sql(pool: str, k: int, diversity: float) -> str:
    """Picks from a table pool (vec_id, vec, rank): a row of each open candidate for each place, with its nearness to what was picked."""
    value = f"{1 - diversity} * (1 - rank / (n - 1.0)) - {diversity} * near"
    return f"""WITH RECURSIVE {pool}, size AS (SELECT count(*) AS n FROM pool),
    r AS (
        SELECT 1 AS place, vec_id, rank, vec, (-1e9)::DOUBLE AS near, rank = 0 AS pick FROM pool
        UNION ALL
        SELECT place, vec_id, rank, vec, near, row_number() OVER (ORDER BY {value} DESC, rank) = 1 FROM (
            SELECT o.place + 1 AS place, o.vec_id, o.rank, o.vec, greatest(o.near, list_inner_product(o.vec, l.vec)) AS near
            FROM (SELECT *, max(CASE WHEN pick THEN vec_id END) OVER () AS last FROM r WHERE place < {k}) o JOIN pool l ON l.vec_id = o.last
            WHERE NOT o.pick
        ), size
    )
    SELECT vec_id, place::INT AS place FROM r WHERE pick"""


@query(mmr_sql("pool AS (SELECT vec_id, vec, row_number() OVER (ORDER BY score DESC, item_key, t) - 1 AS rank FROM p ORDER BY score DESC, item_key, t LIMIT 120)", 20, 0.4), "p")
def mmr_diversify(spark, folder):
    top = preference.ranked(preferred(spark, folder).orderBy(*search.best_first()).limit(120))
    return preference.diversify(top, 20, 0.4)


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS rk FROM p),
    fr AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM v
    WHERE v.profile = 'toxic' AND v.item_key = k.item_key AND round(v.t, 2) = round(k.t, 2))),
    o AS (SELECT *, {chance('vec_id', 'cand')} AS u FROM fr WHERE rk > 3),
    o2 AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY u, vec_id) AS pk FROM o),
    rn AS (SELECT vec_id, 'random' AS source FROM o2 WHERE pk <= 2 ORDER BY u, vec_id LIMIT 20) SELECT * FROM rn
    UNION ALL SELECT * FROM (SELECT vec_id, 'top' AS source FROM fr WHERE rk <= 3
    ORDER BY score DESC, vec_id LIMIT 50 - (SELECT count(*) FROM rn))""", "p v")
def candidates_top_random(spark, folder):
    done = verdicts(spark, folder).where("profile = 'toxic'")
    return sampling.top_and_random(preferred(spark, folder), done, 3, 2, 50, "cand").select("vec_id", "source")


@query("""WITH f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM v
    WHERE v.item_key = p.item_key AND round(v.t, 2) = round(p.t, 2))) SELECT vec_id FROM f
    ORDER BY abs(score - (SELECT median(score) FROM f)), item_key, t LIMIT 1""", "p v")
def uncertain_next(spark, folder):
    return preference.least_certain(preferred(spark, folder).drop("vec"), verdicts(spark, folder), by_median=True).select("vec_id")


@query("""SELECT profile, count(*) FILTER (seq % 2 = 0) >= 25 AND max(label) = 1 AND min(label) = 0 AS due FROM v
    GROUP BY profile""", "v")
def training_due(spark, folder):
    return preference.training_due(verdicts(spark, folder).withColumn("since", F.col("seq") % 2 == 0), "since")


@query(f"SELECT vec_id FROM s ORDER BY {chance('vec_id', 'uniform')}, vec_id LIMIT 40", "s")
def random_samples(spark, folder):
    return sampling.uniform_sample(samples(spark, folder), "vec_id", 40, "uniform").select("vec_id")


SCORES = """WITH sc AS (SELECT o_orderkey AS item_key, k * 8.0 AS t, ln(1 + o_totalprice) * (1 + (o_orderkey + k) % 7) / 50
    - 0.5 AS score FROM orders, range(0, 3) r(k)), de AS (SELECT o_orderkey AS item_key, o_orderkey % 9 AS counter,
    CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100)::DOUBLE END AS rating FROM orders)"""


def item_scores(spark, folder):
    """Three scored samples of each order, as items of entities."""
    o = by_item(spark, folder, table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    o = o.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    score = F.log(1 + F.col("o_totalprice")) * (1 + (F.col("o_orderkey") + F.col("k")) % 7) / 50 - 0.5
    return o.select(F.col("o_orderkey").alias("item_key"), (F.col("k") * 8.0).alias("t"), score.alias("score"))


def item_details(spark, folder):
    k = F.col("o_orderkey")
    o = by_item(spark, folder, table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return o.select(k.alias("item_key"), (k % 9).alias("counter"), F.when(k % 5 > 0, (k % 100).cast("double")).alias("rating"))


BOARD = f"""{SCORES}, it AS (SELECT item_key, count(*) AS n, max(score) AS best, sum(score) AS total FROM sc GROUP BY 1),
    bo AS (SELECT entity, count(DISTINCT item_key) AS items, sum(n)::BIGINT AS moments, greatest(0.0, max(best)) AS
    best, sum(total) / sum(n) AS affinity, coalesce(sum(counter), 0)::BIGINT AS counter, avg(rating) AS rating
    FROM b JOIN it USING (item_key) LEFT JOIN de USING (item_key) GROUP BY entity)"""


def board(spark, folder):
    return entities.leaderboard(bridge(spark, folder), item_scores(spark, folder), item_details(spark, folder))


@query(f"""{BOARD} SELECT entity, items, moments, round(best, 4) AS best, round(affinity, 4) AS affinity, counter,
    round(rating, 4) AS rating FROM bo""", "b")
def entity_leaderboard(spark, folder):
    return entities.ordered(board(spark, folder), "affinity").select("entity", "items", "moments", *[F.round(c, 4).alias(c) for c in ("best", "affinity", "rating")], "counter")


BEST = """pi AS (SELECT item_key, max(score) AS score, arg_max(t, {'s': score, 't': -t}) AS t FROM sc GROUP BY 1),
    be AS (SELECT entity, item_key, t, score, row_number() OVER (PARTITION BY entity
    ORDER BY score DESC, item_key) AS rank FROM b JOIN pi USING (item_key))"""


@query(f"""{SCORES}, {BEST} SELECT entity, item_key, t::DOUBLE AS t, round(score, 4) AS score, rank::INT AS rank FROM be
    WHERE rank <= 6""", "b")
def entity_best(spark, folder):
    return entities.best_moments(bridge(spark, folder), item_scores(spark, folder)).select("entity", "item_key", "t", F.round("score", 4).alias("score"), "rank")


@query(f"""{BOARD}, {BEST}, ch AS (SELECT entity, affinity FROM bo ORDER BY affinity DESC, entity LIMIT 10)
    SELECT entity, round(affinity, 4) AS affinity, item_key, t::DOUBLE AS start, (t + 20)::DOUBLE AS \"end\",
    round(score, 4) AS score FROM ch JOIN be USING (entity) WHERE rank <= 2""", "b")
def hall_of_fame(spark, folder):
    best = entities.best_moments(bridge(spark, folder), item_scores(spark, folder))
    out = entities.hall_of_fame(board(spark, folder), best, 10, 2)
    return out.select("entity", F.round("affinity", 4).alias("affinity"), "item_key", "start", "end", F.round("score", 4).alias("score"))


@query(f"""{BOARD} SELECT entity FROM bo WHERE moments >= 20 OR NOT (SELECT bool_or(moments >= 20) FROM bo)
    ORDER BY -ln({chance('entity', 'spin')}) / greatest(0.01, CASE WHEN coalesce(affinity, 0) = 0 THEN 0.1
    ELSE affinity END), entity LIMIT 1""", "b")
def roulette(spark, folder):
    return sampling.roulette(board(spark, folder), "entity", "spin").select("entity")


GROUPS = """WITH g AS (SELECT DISTINCT grp AS entity, item_key FROM s),
    ec AS (SELECT entity, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS vec
    FROM (SELECT entity, list(a ORDER BY i) AS w FROM (SELECT entity, i, sum(vec[i]) AS a FROM g
    JOIN s USING (item_key), range(1, 65) r(i) GROUP BY 1, 2) GROUP BY entity))"""


def group_vectors(spark, folder):
    s = samples(spark, folder)
    return entities.centroids(s.select(F.col("grp").alias("entity"), "item_key").distinct(), s)


@query(f"""{GROUPS} SELECT b.entity, round(list_inner_product(a.vec, b.vec), 4) AS score FROM ec a, ec b
    WHERE a.entity = 2 AND b.entity <> 2""", "s")
def entity_similar(spark, folder):
    return entities.similar(group_vectors(spark, folder), 2).select("entity", F.round("score", 4).alias("score"))


@query(f"""{GROUPS}, h AS (SELECT entity, term, list_inner_product(ec.vec, voc.vec) AS score FROM ec, voc),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, term) AS rank FROM h)
    SELECT entity, term, round(score, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 8""", "s voc")
def entity_fingerprint(spark, folder):
    return entities.fingerprint(group_vectors(spark, folder), vocabulary(spark, folder)).select("entity", "term", F.round("score", 4).alias("score"), "rank")


@query("""WITH x AS (SELECT vec_id, item_key, row_number() OVER (PARTITION BY item_key
    ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY item_key) AS n FROM s) SELECT vec_id, item_key FROM x
    WHERE i % greatest(1, n // 6) = 0""", "s")
def entity_spread(spark, folder):
    return sampling.time_spread(samples(spark, folder), 6).select("vec_id", "item_key")


@query("""WITH x AS (SELECT score FROM p WHERE item_key IN (SELECT item_key FROM s WHERE grp = 4)),
    g AS (SELECT min(score) AS lo, max(score) AS hi FROM x),
    n AS (SELECT least(floor((score - lo) / (hi - lo) * 20)::INT, 19) AS bin, count(*) AS n FROM x, g GROUP BY 1)
    SELECT k::INT AS bin, coalesce(n, 0) AS n FROM g, range(0, 20) r(k) LEFT JOIN n ON n.bin = k""", "p")
def entity_distribution(spark, folder):
    s = samples(spark, folder)
    own = entities.moments_of(s.select(F.col("grp").alias("entity"), "item_key").distinct(), preferred(spark, folder), 4)
    return metrics.histogram(own, 20).select("bin", "n")


@query("""SELECT entity, items FROM (SELECT l_suppkey AS entity, count(DISTINCT l_orderkey) AS items FROM lineitem
    GROUP BY 1) JOIN supplier ON s_suppkey = entity
    WHERE regexp_matches(s_name, '[02468]$') AND lower(trim(s_name)) NOT IN ('supplier#000000002')
    ORDER BY items DESC, entity LIMIT 1""")
def entity_resolve(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    return entities.resolve(bridge(spark, folder), names, item_scores(spark, folder), "[02468]$", [" Supplier#000000002 "]).select("entity", "items")


CACHE = """WITH ca AS (SELECT o_orderkey AS item_key, 'p' || o_custkey AS path, o_orderkey % 100 AS item_id FROM orders
    WHERE o_orderkey % 10 < 7), li AS (SELECT o_orderkey AS item_key, CASE WHEN o_orderkey % 6 = 0 THEN 'q'
    ELSE 'p' END || o_custkey AS path, o_orderkey % 100 AS item_id FROM orders WHERE o_orderkey % 10 > 2)"""


def cached_and_live(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    cached = o.where("o_orderkey % 10 < 7").select(k.alias("item_key"), F.concat(F.lit("p"), "o_custkey").alias("path"), (k % 100).alias("item_id"))
    live = o.where("o_orderkey % 10 > 2").select(k.alias("item_key"), F.concat(F.when(k % 6 == 0, "q").otherwise("p"), "o_custkey").alias("path"), (k % 100).alias("item_id"))
    return cached, live


@query(f"""{CACHE} SELECT coalesce(ca.item_key, li.item_key) AS item_key, CASE WHEN li.item_key IS NULL THEN 'orphaned'
    WHEN ca.item_key IS NULL THEN 'new' WHEN ca.path <> li.path OR ca.item_id <> li.item_id THEN 'moved'
    ELSE 'cached' END AS status FROM ca FULL JOIN li ON ca.item_key = li.item_key""")
def reconcile_status(spark, folder):
    return catalog.reconcile(*cached_and_live(spark, folder))


@query(f"{CACHE} SELECT item_key, path FROM ca WHERE item_key IN (SELECT item_key FROM li)")
def cache_prune(spark, folder):
    return catalog.prune(*cached_and_live(spark, folder)).select("item_key", "path")


@query(f"""{CACHE} SELECT item_key FROM li WHERE NOT EXISTS (SELECT 1 FROM ca
    WHERE ca.item_key = li.item_key AND ca.item_key % 3 > 0)""")
def resumable_todo(spark, folder):
    cached, live = cached_and_live(spark, folder)
    signed = cached.withColumn("signature", F.when(F.col("item_key") % 3 > 0, 8.0).otherwise(2.0)).withColumn("model", F.lit("a"))
    return catalog.todo(live.withColumn("signature", F.lit(8.0)).withColumn("model", F.lit("a")), signed).select("item_key")


@query("""SELECT count(*) AS items, round(sum(CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END) / 3600, 4) AS hours,
    sum(o_orderkey % 4)::BIGINT AS markers, count(*) FILTER (o_orderkey % 11 = 0) AS without_duration FROM orders""")
def library_stats(spark, folder):
    o = table(spark, folder, "orders")
    return catalog.library_stats(o.select(F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice")).alias("duration"), (F.col("o_orderkey") % 4).alias("markers")))


@query("""SELECT p_partkey, path FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/lib/a'
    WHEN 1 THEN '/lib/a/' || p_name WHEN 2 THEN '/lib/ab/' || p_name ELSE '/other/' || p_name END AS path FROM part)
    WHERE path = '/lib/a' OR starts_with(path, '/lib/a/')""")
def path_scope(spark, folder):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "/lib/a").when(k == 1, F.concat(F.lit("/lib/a/"), "p_name")).when(k == 2, F.concat(F.lit("/lib/ab/"), "p_name")).otherwise(F.concat(F.lit("/other/"), "p_name"))
    rows = table(spark, folder, "part").select("p_partkey", path.alias("path"))
    return rows.where(scalars.under_path(F.col("path"), "/lib/a/"))


FAILED = """WITH fl AS (SELECT event_id, user_id AS item_key, left('failure ' || event_id || repeat('x', 600), 500) AS
    error, epoch_us(ts) / 1e6 AS ts FROM events WHERE event_type = 'error')"""


def failures(spark, folder):
    from ..sources.tables import seconds

    e = table(spark, folder, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("item_key"), F.concat(F.lit("failure "), "event_id", F.lit("x" * 600)).alias("error"), seconds(F.col("ts")).alias("ts"), "event_id")


@query(f"""{FAILED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY ts DESC) AS n FROM fl)
    SELECT item_key, error, round(ts, 3) AS ts FROM r WHERE n = 1 AND item_key % 5 > 0""")
def failure_upsert(spark, folder):
    f = failures(spark, folder)
    log = catalog.record_failures(catalog.upsert(f.where("event_id % 2 = 0").withColumn("error", F.left("error", F.lit(500))), f.where("false"), ["item_key"]), f.where("event_id % 2 = 1"))
    done = f.where("item_key % 5 = 0").select("item_key").distinct()
    return catalog.resolve_failures(log, done).select("item_key", "error", F.round("ts", 3).alias("ts"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'o' || c_custkey WHEN c_custkey % 4 = 1 THEN 'm' || c_custkey
    WHEN c_custkey % 4 = 2 THEN 'z' || c_custkey ELSE 'path-' || substr(sha1(c_name), 1, 16) END AS item_key
    FROM customer""")
def fingerprint_pick(spark, folder):
    k = F.col("c_custkey")

    def one(name: str, letter: str):
        return F.create_map(F.lit(name), F.concat(F.lit(letter), k))

    prints = F.when(k % 4 == 0, F.map_concat(one("md5", "m"), one("oshash", "o"))).when(k % 4 == 1, one("md5", "m")).when(k % 4 == 2, one("other", "z")).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, folder, "customer").select("c_custkey", scalars.fingerprint_key(prints, F.col("c_name")).alias("item_key"))


@query("""SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}_-]', '_', 'g') AS tag, CASE WHEN n = '' THEN 'reel'
    ELSE n END AS name FROM (SELECT *, substr(trim(regexp_replace(p_type || '!' || p_name, '[^\\p{L}\\p{N}._-]',
    '-', 'g'), '-.'), 1, 20) AS n FROM part)""")
def safe_names(spark, folder):
    p = table(spark, folder, "part")
    return p.select("p_partkey", scalars.safe_tag(F.col("p_name")).alias("tag"), scalars.safe_name(F.concat("p_type", F.lit("!"), "p_name"), 20).alias("name"))


@query("""SELECT c_custkey, unnest(list_transform(range(0, greatest(0, ceil((c_acctbal - 2) / 900)::BIGINT)), lambda i:
    round(i * 900.0 + 2, 3)))::DOUBLE AS t FROM customer WHERE c_acctbal > 0""")
def time_plan(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.explode(scalars.plan_timestamps(F.col("c_acctbal"), 900.0, 2.0)).alias("t"))


@query("""SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NEW'
    ELSE o_orderstatus END AS title, (greatest(o_orderkey % 5 + CASE WHEN o_orderkey % 2 = 0 THEN -2
    ELSE 0 END, 0))::BIGINT AS counter, CASE WHEN o_orderkey % 4 = 0 THEN 'base,x,y' ELSE 'base' END AS tags
    FROM orders""")
def item_updates(spark, folder):
    k = F.col("o_orderkey")
    items = table(spark, folder, "orders").select(k.alias("item_id"), F.col("o_orderstatus").alias("title"), (k % 5).alias("counter"), F.array(F.lit("base")).alias("tags"))
    edited = catalog.update_items(items, items.where("item_id % 3 = 0").select("item_id", F.lit("NEW").alias("title")), ["title"])
    bumped = catalog.bump(edited, items.where("item_id % 2 = 0").select("item_id", F.explode(F.array(F.lit(-1), F.lit(-1))).alias("delta")), "counter")
    tagged = catalog.add_tags(bumped, items.where("item_id % 4 = 0").select("item_id", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("base"))).alias("tag")))
    return tagged.select("item_id", "title", "counter", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query(f"""{FAILED}, r AS (SELECT item_key, (row_number() OVER (ORDER BY event_id)) % 3 AS st FROM fl)
    SELECT item_key, 1 AS step, 'interval' AS mode, 'jpeg' AS pipeline FROM r WHERE st = 0""")
def failure_retries(spark, folder):
    f = numbered(failures(spark, folder), "event_id").withColumn("st", F.col("place") % 3)
    tried = f.select("item_key", F.when(F.col("st") == 0, "sparse").otherwise("interval").alias("mode"), F.when(F.col("st") == 0, "raw").otherwise("jpeg").alias("pipeline"))
    return catalog.retry_ladder(tried, [("sparse", "raw"), ("interval", "jpeg")])


@query("SELECT m.marker_id, m.title FROM m WHERE item_key = 17", "m")
def item_markers(spark, folder):
    return markers(spark, folder).where("item_key = 17").select("marker_id", "title")


@query("SELECT entity, item_key FROM b WHERE entity = 5 ORDER BY item_key LIMIT 100", "b")
def entity_items(spark, folder):
    return bridge(spark, folder).where("entity = 5").orderBy("item_key").limit(100)


TAG_NAMES = ("NATION_7", "beach", "NATION_3", "sunset", "beach")


@query(
    """
    WITH w AS (SELECT * FROM (VALUES (0, 'NATION_7'), (1, 'beach'), (2, 'NATION_3'), (3, 'sunset')) x(place, name)),
    f AS (SELECT place, name, min(n_nationkey) AS id FROM w LEFT JOIN nation ON n_name = name GROUP BY place, name)
    SELECT coalesce(id, (SELECT max(n_nationkey) FROM nation) + count(*) FILTER (id IS NULL) OVER (ORDER BY place))::BIGINT AS tag_id,
        name, id IS NULL AS created FROM f
    """
)
def tag_ensure(spark, folder):
    """Tags found by name, and made where there is none."""
    tags = table(spark, folder, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("name"))
    return catalog.ensure_tags(tags, TAG_NAMES)


@query(
    """
    SELECT marker_id, item_key, start, title FROM m WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = marker_id)
    UNION ALL SELECT -1 - doc_id, doc_id // 10, ((doc_id % 10) * 8)::DOUBLE, 'toxic' FROM labels WHERE toxic = 1
    """,
    "m",
)
def marker_changes(spark, folder):
    """Markers after some are destroyed and others created."""
    labels = table(spark, folder, "labels")
    kept = catalog.remove(markers(spark, folder), labels.select(F.col("doc_id").alias("marker_id")), "marker_id")
    toxic = verdicts(spark, folder).where("profile = 'toxic' AND label = 1")
    new = toxic.select((-1 - F.col("seq")).alias("marker_id"), "item_key", F.col("t").alias("start"), F.lit("toxic").alias("title"))
    return catalog.create(kept, new, "marker_id").select("marker_id", "item_key", "start", "title")


@query("SELECT item_key, min(entity) AS first_entity, max(entity) AS last_entity FROM b GROUP BY item_key", "b")
def item_lookup(spark, folder):
    """The first and the last entity of each item: lookups in which the first or the last one wins."""
    rows = bridge(spark, folder).withColumn("place", F.col("entity"))
    first = catalog.lookup(rows, "item_key", "entity", "place").withColumnRenamed("entity", "first_entity")
    return first.join(catalog.lookup(rows, "item_key", "entity", "place", last=True).withColumnRenamed("entity", "last_entity"), "item_key")


@query(
    f"""
    WITH k AS (SELECT item_key FROM (SELECT DISTINCT item_key FROM s) ORDER BY {chance("item_key", "calibrate")}, item_key LIMIT 300)
    SELECT round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.97), 6) AS p97,
        round(quantile_cont(score, 0.99), 6) AS p99, round(avg((score >= 0.15)::INT), 6) AS above FROM p WHERE item_key IN (SELECT item_key FROM k)
    """,
    "s p",
)
def calibration_sample(spark, folder):
    """The calibration read-out over the samples of 300 items drawn at random."""
    c = metrics.calibration(sampling.key_sample(preferred(spark, folder), "item_key", 300, "calibrate"), 0.15)
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query("SELECT s_suppkey AS entity, s_name AS name FROM supplier WHERE contains(lower(s_name), 'r#00000000')")
def entity_named(spark, folder):
    """Entities whose name holds a text."""
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    return entities.named_like(names, " R#00000000 ")


def _side(entity: int, side: str) -> str:
    of = ", ".join(f"({c!r}, {c}::DOUBLE)" for c in ("items", "moments", "best", "affinity", "counter", "rating"))
    return f"(SELECT x.measure, round(x.value, 4) AS {side} FROM bo, LATERAL (VALUES {of}) x(measure, value) WHERE entity = {entity})"


@query(f"{BOARD} SELECT measure, one, other FROM {_side(1, 'one')} FULL JOIN {_side(2, 'other')} USING (measure)", "b")
def entity_compare(spark, folder):
    """Two rows of the leaderboard side by side."""
    c = entities.compared(board(spark, folder), 1, 2).where("measure <> 'ratings'")
    return c.select("measure", *[F.round(x, 4).alias(x) for x in ("one", "other")])


BOOTSTRAP = f"""
WITH w AS (SELECT vec_id, grp, 1.0::DOUBLE + vec_id % 3 AS w, floor({chance("vec_id", "boot:slot")} * 256) AS slot FROM s),
c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY slot, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum(w) OVER (PARTITION BY grp) AS total FROM w),
d AS (SELECT grp, k AS draw, {chance("grp::VARCHAR || ':' || k", "boot")} AS u FROM (SELECT DISTINCT grp FROM s), range(1, 51) r(k))
SELECT c.grp, c.vec_id, count(*) AS n FROM d JOIN c ON c.grp = d.grp AND d.u * total >= hi - w AND d.u * total < hi GROUP BY c.grp, c.vec_id
"""


@query(BOOTSTRAP, "s")
def bootstrap_sizes(spark, folder):
    """How often each sample is among fifty draws with replacement from its group, in proportion to a weight."""
    rows = samples(spark, folder).withColumn("w", 1.0 + F.col("vec_id") % 3)
    return sampling.weighted_bootstrap(rows, "vec_id", "w", 50, "boot", "grp").groupBy("grp", "vec_id").agg(F.count(F.lit(1)).alias("n"))


BOARD_POOL = f"""un AS (
    SELECT vec_id, item_key, t, vec, score, row_number() OVER (ORDER BY score DESC, item_key, t) - 1 AS best
    FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS n FROM p) WHERE n <= 4),
dr AS (SELECT *, -ln({chance("vec_id", "diverse")}) / exp(-best / (SELECT greatest(count(*) / 4.0, 36, 200)::DOUBLE FROM un)) AS race FROM un),
pool AS (SELECT vec_id, vec, row_number() OVER (ORDER BY race, vec_id) - 1 AS rank FROM dr ORDER BY race, vec_id LIMIT 36)"""


@query(mmr_sql(BOARD_POOL, 12, 0.3), "p")
def board_diverse(spark, folder):
    """Twelve moments of a board without a floor: three times as many drawn by rank, then spread."""
    return sampling.diverse_board(pool(spark, folder), 12, 0.3, "diverse")


FEED_POOL = f"""ca AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS n FROM p),
tp AS (SELECT * FROM ca WHERE n <= 2 ORDER BY score DESC, item_key, t LIMIT 300),
fl AS (SELECT * FROM tp WHERE item_key % 5 <> 0 AND score >= 0.0),
x AS (SELECT *, list_inner_product(vec, (SELECT vec FROM s WHERE vec_id = 3)) AS liking FROM fl),
bl AS (SELECT *, 0.8 * liking + 0.2 * CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS blend FROM x),
rk AS (SELECT *, row_number() OVER (ORDER BY blend DESC, item_key, t) - 1 AS best FROM bl),
pool AS (SELECT vec_id, vec, row_number() OVER (ORDER BY -ln({chance("vec_id", "feed")}) / exp(-best / 20.0), vec_id) - 1 AS rank FROM rk)"""


@query(mmr_sql(FEED_POOL, 10, 0.3), "p")
def feed_recommend(spark, folder):
    """Ten moments for a feed: pool, seen items out, floor, blend with a second score, shuffle, spread."""
    s = samples(spark, folder)
    second = s.where("vec_id = 3").select(F.col("vec").alias("query"))
    seen = s.where("item_key % 5 = 0").select("item_key").distinct()
    return preference.recommend(preferred(spark, folder), 10, "feed", 0.3, seen, 0.0, lambda rows: search.scored(rows, second, "liking"))


@query("""WITH b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS n
    FROM p) WHERE n = 1) SELECT vec_id, item_key, item_key % 3 > 0 AS again FROM b1
    ORDER BY again, score DESC, item_key, t LIMIT 40""", "p")
def feed_next(spark, folder):
    seen = samples(spark, folder).where("item_key % 3 > 0").select("item_key")
    return preference.next_batch(search.capped(preferred(spark, folder), "item_key", 1), seen, 40).select("vec_id", "item_key", "again")


OWN = "ow AS (SELECT * FROM s WHERE item_key IN (SELECT item_key FROM s WHERE grp = 4))"


@query(f"""WITH one AS (SELECT vec AS query FROM s WHERE item_key = 7 ORDER BY abs(t - 17.0), t LIMIT 1), {OWN},
    h AS (SELECT vec_id, item_key, t, list_inner_product(vec, query) AS score FROM ow, one),
    c AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, t) AS r FROM h)
    SELECT vec_id, item_key, t, round(score, 4) AS score FROM c WHERE r <= 2
    ORDER BY c.score DESC, item_key, t LIMIT 40""", "s")
def entity_matches(spark, folder):
    """Moments of an entity's items most like one moment."""
    s = samples(spark, folder)
    bridge_ = s.select(F.col("grp").alias("entity"), "item_key").distinct()
    return shown(entities.moment_matches(bridge_, s, 4, search.vector_at(s, 7, 17.0), 40, 2))


@query(f"""WITH {OWN}, x AS (SELECT *, row_number() OVER (PARTITION BY item_key
    ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY item_key) AS n FROM ow) SELECT vec_id, item_key FROM x
    WHERE i % greatest(1, n // 3) = 0 ORDER BY {chance('vec_id', 'board4')}, vec_id LIMIT 30""", "s")
def entity_board(spark, folder):
    """Moments of an entity's items, spread over time, in random order."""
    s = samples(spark, folder)
    bridge_ = s.select(F.col("grp").alias("entity"), "item_key").distinct()
    return entities.board(bridge_, s, 4, 30, 3, "board4").select("vec_id", "item_key")


@query("""SELECT doc_id, list_sum(list_transform(range(1, 5), lambda i: (('0x' || substr(sha256(doc_id::VARCHAR || ':' ||
    i), 1, 8))::UBIGINT)::DOUBLE))::DOUBLE AS total FROM documents""")
def stand_in_embedding(spark, folder):
    """The numbers behind the deterministic stand-in embedder, before scaling, summed."""
    raw = scalars.hash_numbers(F.col("doc_id").cast("string"), 4)
    return table(spark, folder, "documents").select("doc_id", F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x).alias("total"))


@query("""SELECT vec_id AS item_key, round(list_inner_product(u, u), 4) AS norm
    FROM (SELECT vec_id, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS u FROM s)""", "s")
def incremental_pass(spark, folder):
    """Embeds the landed samples in one pass of a stream, twice: the second pass finds nothing new."""
    import uuid

    from ..sources.scratch import shared_folder
    from ..streaming.incremental import landed, pass_over

    base = f"{shared_folder(spark)}/pass-{uuid.uuid4().hex}"
    rows = table(spark, folder, "embeddings")
    embed = lambda b: b.select("item_key", unit(F.col("embedding").cast("array<double>")).alias("vec"))
    for n in (1, 2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/embeddings.parquet*")
        stream = stream.withColumnRenamed("vec_id", "item_key")
        pass_over(stream, f"{base}/out", f"{base}/checkpoint{n}", embed).awaitTermination()
    return landed(spark, f"{base}/out").select("item_key", F.round(dot("vec", "vec"), 4).alias("norm"))
