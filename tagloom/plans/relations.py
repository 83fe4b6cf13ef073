"""Logical relations as projections of stored tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SESSION = "user_id * 100 + extract(day FROM ts)"
TAG = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

RELATIONS: dict[str, str] = {
    "memories": "SELECT o_orderkey AS memory_id, o_orderdate AS created_at, o_orderpriority AS source_model, o_orderstatus = 'F' AS is_archived FROM orders",
    "memory_tags": "SELECT DISTINCT l_orderkey AS memory_id, p_size AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "basket_tags": "SELECT DISTINCT p_size AS tag_id FROM part",
    "brands": "SELECT DISTINCT p_brand AS name, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS id FROM part",
    "tag_events": f"SELECT event_id, {TAG} AS tag_id, event_type, ts AS occurred_at, value FROM events",
    "event_tags": f"SELECT DISTINCT {TAG} AS tag_id FROM events",
    "hits": f"SELECT DISTINCT CAST({SESSION} AS BIGINT) AS retrieval_id, {TAG} AS tag_id, ts AS occurred_at FROM events",
    "session_tags": f"SELECT DISTINCT CAST({SESSION} AS BIGINT) AS retrieval_id, {TAG} AS tag_id FROM events",
    "results": f"SELECT CAST({SESSION} AS BIGINT) AS retrieval_id, event_id AS memory_id, value AS score FROM events",
    "user_tags": f"SELECT DISTINCT user_id AS memory_id, {TAG} AS tag_id FROM events",
    # Tags by parity of the day, as two projects; names share a form.
    "pairs": f"SELECT x.tag_id AS tag_a_id, y.tag_id AS tag_b_id, count(*) AS cnt FROM (SELECT DISTINCT user_id AS u, {TAG} AS tag_id FROM events) x JOIN (SELECT DISTINCT user_id AS u, {TAG} AS tag_id FROM events) y ON x.u = y.u AND x.tag_id < y.tag_id GROUP BY 1, 2",
    "tensor": """SELECT tag_a_id, tag_b_id, cnt, ln(1e0 + cnt) / 12e0 AS cooccurrence,
        greatest(0e0, cos(1.3e0 * tag_a_id) * cos(1.3e0 * tag_b_id)) AS synchronicity,
        greatest(0e0, cos(0.7e0 * (tag_a_id - tag_b_id))) AS semantic,
        greatest(0e0, sin(0.9e0 * tag_a_id)) * 0.2e0 AS semiotic_forward,
        greatest(0e0, sin(1.1e0 * tag_b_id)) * 0.2e0 AS semiotic_reverse,
        greatest(0e0, cos(2.1e0 * tag_a_id + tag_b_id)) AS glyph,
        greatest(0e0, sin(0.4e0 * (tag_a_id + tag_b_id))) AS inhibition,
        cos(1.7e0 * (tag_a_id - tag_b_id)) AS parallelness FROM pairs WHERE cnt >= 2""",
    "co_edges": "SELECT x.tag_id AS tag_a_id, y.tag_id AS tag_b_id, 1 - power(0.85e0, count(*)) AS strength FROM session_tags x JOIN session_tags y ON x.retrieval_id = y.retrieval_id AND x.tag_id < y.tag_id GROUP BY 1, 2",
    # Tags are named by parts; the first of each type has the type's name alone.
    "tags": "SELECT p_partkey AS tag_id, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1 THEN lower(p_type) ELSE replace(p_name, ' ', '-') END AS name, p_size > 2 AS is_active FROM part WHERE p_partkey IN (SELECT tag_id FROM event_tags)",
    "queries": "SELECT p_partkey AS query_id, concat(p_name, ' of the ', p_type, ', ', p_brand) AS text FROM part WHERE p_partkey % 20 = 0",
    "event_memories": "SELECT event_id AS memory_id, tag_id, event_type FROM tag_events",
    "seeds": "SELECT tag_id FROM event_tags WHERE tag_id < 5",
    "vectors": "SELECT vec_id AS memory_id, 0 AS chunk_index, label AS tag_id, embedding FROM embeddings",
    "near_pairs": """SELECT a.vec_id AS memory_a, b.vec_id AS memory_b, a.label AS tag_a, b.label AS tag_b, (a.vec_id + b.vec_id) % 100 / 100e0 AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 8 AND a.label <= b.label""",
}

#: The same rows in other words, for Spark, where its planner would compare every row with every other.
PLANNED: dict[str, str] = {
    # Ids at most 8 apart are in one band of eight ids or in neighbouring ones.
    "near_pairs": """SELECT a.vec_id AS memory_a, b.vec_id AS memory_b, a.label AS tag_a, b.label AS tag_b, (a.vec_id + b.vec_id) % 100 / 100e0 AS similarity
        FROM (SELECT vec_id, label, explode(array(shiftright(vec_id, 3), shiftright(vec_id, 3) + 1)) AS band FROM embeddings) a
        JOIN (SELECT vec_id, label, shiftright(vec_id, 3) AS band FROM embeddings) b ON a.band = b.band AND b.vec_id - a.vec_id BETWEEN 1 AND 8 AND a.label <= b.label""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table or a relation; what it stands on becomes views of the session."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = PLANNED.get(name, RELATIONS[name])
    for used in sorted(set(re.findall(r"\w+", sql)) & ({*TABLES, *RELATIONS} - {name})):
        relation(spark, sf_dir, used).createOrReplaceTempView(used)
    return spark.sql(sql)


def with_relations(sql: str) -> str:
    """A query after the definitions of the relations, for an engine without the views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in RELATIONS.items()) + "\n" + sql
