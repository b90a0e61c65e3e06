"""Registration of queries: a function (spark, folder) -> DataFrame, and SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL texts.
CTE = {
    "s": """s AS (SELECT vec_id, vec_id // 10 AS item_key, ((vec_id % 10) * 8)::DOUBLE AS t, label AS grp,
    embedding::DOUBLE[] AS vec FROM embeddings)""",
    "e": "e AS (SELECT user_id AS item_key, epoch_us(ts) / 1e6 AS t, event_id, value AS score FROM events)",
    "m": """m AS (SELECT event_id AS marker_id, user_id AS item_key, epoch_us(ts) / 1e6 AS start, CASE
    WHEN event_id % 2 = 0 THEN epoch_us(ts) / 1e6 + 1800.0 END AS stop, printf('%s %.3f', event_type, value) AS
    title FROM events WHERE event_type = 'purchase')""",
    "v": """v AS (SELECT doc_id AS seq, doc_id // 10 AS item_key, ((doc_id % 10) * 8)::DOUBLE AS t, quality AS label,
    'quality' AS profile FROM labels UNION ALL
    SELECT doc_id, doc_id // 10, ((doc_id % 10) * 8)::DOUBLE, toxic, 'toxic' FROM labels)""",
    "voc": """voc AS (SELECT term, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS vec
    FROM (SELECT 'group ' || grp AS term, list(a ORDER BY i) AS w FROM (SELECT grp, i, avg(vec[i]) AS a
    FROM s, range(1, 65) r(i) GROUP BY grp, i) GROUP BY grp))""",
    "q": """q AS (SELECT list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS query FROM (SELECT list(a
    ORDER BY i) AS w FROM (SELECT i, avg(vec[i]) AS a FROM s
    JOIN labels ON vec_id = doc_id AND toxic = 1, range(1, 65) r(i) GROUP BY i)))""",
    "p": "p AS (SELECT vec_id, item_key, t, grp, vec, list_inner_product(vec, query) AS score FROM s, q)",
    "b": "b AS (SELECT DISTINCT l_suppkey AS entity, l_orderkey AS item_key FROM lineitem)",
}
NEEDS = {"voc": ["s"], "q": ["s"], "p": ["s", "q"]}


def with_(names: str, body: str) -> str:
    """``body`` behind the named common tables and those they need."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in found:
            found.append(name)

    for n in names.split():
        add(n)
    own = body.strip()
    start = "WITH RECURSIVE " if own.startswith("WITH RECURSIVE ") else "WITH "
    own = ", " + own[len(start) :] if own.startswith(start) else " " + own
    return start + ", ".join(CTE[n] for n in found) + own


def without_negative_zero(sql: str) -> str:
    """Adds zero to every call of round: the checking engine keeps the sign of a value rounded to zero, Spark does not."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        end, depth = start + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:start]}(round({without_negative_zero(sql[start + 6 : end - 1])}) + 0.0::DOUBLE)"
        at = end
    return out + sql[at:]


def query(sql: str | None = None, needs: str = ""):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = without_negative_zero(with_(needs, sql) if needs else sql.strip())
        return f

    return put


def chance(key: str, seed: str) -> str:
    """SQL of the seeded uniform number."""
    return f"((('0x' || substr(md5(({key})::VARCHAR || '{seed}'), 1, 8))::UBIGINT)::DOUBLE + 0.5) / 4294967296.0"
