"""A query for each operator, over the stored tables, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import scalar as S
from tagloom.functions import vectors as V
from tagloom.operators import cooccurrence as C
from tagloom.operators import lattice as L
from tagloom.operators import memory as M
from tagloom.operators import tensor as T
from tagloom.operators import trends as TR
from tagloom.operators import vector_search as VS
from tagloom.params import Params
from tagloom.plans.relations import relation, with_relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
P = Params()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums are added in any order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(columns: str, sql: str, digits: int = 6) -> str:
    inner = ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
    return f"SELECT * REPLACE ({inner}) FROM ({sql})"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Callable], Callable]:
    """Register a function of a getter of relations as a query; ``doubles`` are rounded in the SQL, as in the result."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(lambda relation_name: relation(spark, sf_dir, relation_name)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_relations(rounded_sql(doubles, sql, digits) if doubles else f"SELECT * FROM ({sql})")
        return f

    return add


# ---- trends and phase space ---------------------------------------------------------------------

AGE = "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(occurred_at)) / 3.6e9"


def _trend_sql(events: str = "tag_events", window: float = 168.0, where: str = "true") -> str:
    return f"""(WITH e AS (SELECT tag_id, {AGE} AS age FROM {events} WHERE {AGE} < {window} AND {where}),
        g AS (SELECT tag_id, sum(exp(-ln(2e0) * age / {window / 2})) AS level,
                sum(CASE WHEN age <= {window / 2} THEN 1e0 ELSE -1e0 END) AS velocity,
                sum(CASE WHEN age <= {window / 3} THEN 1e0 WHEN age <= {2 * window / 3} THEN -2e0 ELSE 1e0 END) AS jerk, count(*) AS event_count FROM e GROUP BY tag_id),
        a AS (SELECT t.tag_id, coalesce(level, 0e0) AS level, coalesce(velocity, 0e0) AS velocity, coalesce(jerk, 0e0) AS jerk, coalesce(event_count, 0) AS event_count FROM event_tags t LEFT JOIN g USING (tag_id)),
        r AS (SELECT *, 0.5e0 * level + 0.35e0 * greatest(0e0, velocity) + 0.15e0 * greatest(0e0, jerk) AS raw FROM a),
        n AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS i, count(*) OVER () AS c, max(raw) OVER () AS m FROM r),
        p AS (SELECT CASE WHEN m <= 0 THEN 1e0 ELSE greatest(raw, 0.01e0) END AS norm FROM n WHERE i = least(CAST(floor(0.9e0 * c) AS BIGINT), c - 1))
        SELECT tag_id, level, velocity, jerk, CASE WHEN event_count = 0 THEN 0e0 ELSE 1e0 / (1e0 + exp(-raw / norm)) END AS temperature, event_count FROM r, p)"""


def _freq_sql(hits: str = "hits", where: str = "true") -> str:
    return f"""(WITH h AS (SELECT tag_id, count(DISTINCT retrieval_id) AS hits FROM {hits} WHERE {AGE} < 168 AND {where} GROUP BY tag_id),
        b AS (SELECT (SELECT coalesce(sum(hits), 0) FROM h) / ((SELECT count(*) FROM event_tags) * 168e0) AS base_rate)
        SELECT t.tag_id, CAST(coalesce(hits, 0) AS BIGINT) AS hits, base_rate,
          CASE WHEN coalesce(hits, 0) = 0 THEN 0e0 WHEN base_rate <= 0 THEN 0.9e0 ELSE (hits / 168e0) / (hits / 168e0 + base_rate) END AS retrieval_freq
        FROM event_tags t LEFT JOIN h USING (tag_id), b)"""


def _phase_sql(trend: str, freq: str) -> str:
    return f"""(SELECT t.tag_id, temperature, retrieval_freq,
        CASE WHEN temperature >= 0.5 AND retrieval_freq >= 0.5 THEN 'active_deep_work' WHEN temperature >= 0.5 THEN 'novel_exploration' WHEN retrieval_freq >= 0.5 THEN 'dormant_reactivation' ELSE 'inactive' END AS quadrant,
        (retrieval_freq - temperature) / sqrt(2e0) AS off_diagonal_distance FROM {trend} t JOIN {freq} f USING (tag_id))"""


@query("phase_space", f"SELECT * FROM {_phase_sql(_trend_sql(), _freq_sql())}", "temperature, retrieval_freq, off_diagonal_distance")
def phase_space(t):  # noqa: ANN001, ANN201
    return TR.phase_space(TR.trends(t("tag_events"), t("event_tags")), TR.retrieval_frequency(t("hits"), t("event_tags")))


@query("trends", f"SELECT * FROM {_trend_sql()}", "level, velocity, jerk, temperature")
def trends(t):  # noqa: ANN001, ANN201
    return TR.trends(t("tag_events"), t("event_tags"))


@query("retrieval_frequency", f"SELECT * FROM {_freq_sql()}", "base_rate, retrieval_freq")
def retrieval_frequency(t):  # noqa: ANN001, ANN201
    return TR.retrieval_frequency(t("hits"), t("event_tags"))


@query("tag_hits_per_hour", f"SELECT tag_id, count(DISTINCT retrieval_id) AS hits, count(DISTINCT retrieval_id) / 168e0 AS per_hour FROM hits WHERE {AGE} < 168 GROUP BY tag_id", "per_hour")
def tag_hits(t):  # noqa: ANN001, ANN201
    return TR.tag_hits_per_hour(t("hits"))


@query("quadrant_populations", f"SELECT quadrant, count(*) AS tags FROM {_phase_sql(_trend_sql(), _freq_sql())} GROUP BY quadrant")
def quadrants(t):  # noqa: ANN001, ANN201
    return TR.quadrant_populations(phase_space(t))


@query("off_diagonal_tags", f"SELECT * FROM {_phase_sql(_trend_sql(), _freq_sql())} WHERE abs(off_diagonal_distance) >= 0.15", "temperature, retrieval_freq, off_diagonal_distance")
def off_diagonal(t):  # noqa: ANN001, ANN201
    return TR.off_diagonal_tags(phase_space(t), 0.15)


_STORES, _READS = "event_type IN ('purchase', 'signup')", "event_type NOT IN ('purchase', 'signup')"
_READ_HITS = "(SELECT DISTINCT CAST(user_id * 100 + extract(day FROM ts) AS BIGINT) AS retrieval_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS tag_id, ts AS occurred_at FROM events WHERE event_type NOT IN ('purchase', 'signup'))"


@query(
    "dormant_reactivation",
    f"""SELECT tag_id, temperature, retrieval_freq, z AS strength FROM (SELECT *, (off_diagonal_distance - avg(off_diagonal_distance) OVER ()) / stddev_samp(off_diagonal_distance) OVER () AS z
        FROM {_phase_sql(_trend_sql(window=12.0, where=_STORES), _freq_sql(_READ_HITS))}) WHERE quadrant = 'dormant_reactivation' AND z > 1 AND temperature < 0.3""",
    "temperature, retrieval_freq, strength",
)
def dormant(t):  # noqa: ANN001, ANN201
    reads = t("events").filter(_READS).selectExpr("CAST(user_id * 100 + extract(day FROM ts) AS BIGINT) AS retrieval_id", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS tag_id", "ts AS occurred_at")
    trend = TR.trends(t("tag_events").filter(_STORES), t("event_tags"), replace(P, window_hours=12.0))
    return TR.dormant_reactivations(TR.phase_space(trend, TR.retrieval_frequency(reads, t("event_tags"))), params=replace(P, sigma=1.0))


@query("latest_snapshots", "SELECT tag_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY occurred_at DESC, event_id DESC) AS r FROM tag_events) WHERE r = 1", "value")
def latest(t):  # noqa: ANN001, ANN201
    # Time and id make the order total.
    at = F.struct("occurred_at", "event_id")
    return TR.latest_snapshots(t("tag_events").withColumn("computed_at", at)).select("tag_id", "event_id", "value")


@query("trend_history", "SELECT tag_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY occurred_at DESC, event_id DESC) AS r FROM tag_events) WHERE r <= 30")
def history(t):  # noqa: ANN001, ANN201
    return TR.latest_snapshots(t("tag_events").withColumn("computed_at", F.struct("occurred_at", "event_id")), 30).select("tag_id", "event_id")


@query(
    "usage_salience",
    f"""SELECT user_id, 1e0 / (1e0 + exp(-6e0 * (0.4e0 * least(ln(1e0 + n) / ln(101e0), 1e0) + 0.4e0 * exp(-ln(2e0) * age / 168e0) + 0.2e0 * CASE WHEN uses > 0 THEN good / uses ELSE 0.5e0 END - 0.5e0))) AS salience
        FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, min({AGE.replace("occurred_at", "ts")}) AS age, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS good,
          CAST(sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) AS DOUBLE) AS uses FROM events GROUP BY user_id)""",
    "salience",
)
def salience(t):  # noqa: ANN001, ANN201
    kind, age = F.col("event_type"), S.hours_between(F.lit(P.now).cast("timestamp"), F.col("ts"))
    g = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(age).alias("age"), F.sum(F.when(kind == "purchase", 1).otherwise(0)).alias("good"), F.sum(F.when(kind.isin("purchase", "error"), 1).otherwise(0)).alias("uses"))
    return g.select("user_id", S.usage_salience(F.col("n"), F.col("age"), F.col("good"), F.col("uses")).alias("salience"))


@query("composite_salience", "SELECT l_orderkey, l_linenumber, 0.6e0 * l_discount + 0.4e0 * l_tax AS composite, greatest(0e0, least(1e0, l_discount * 20e0)) AS clamped FROM lineitem", "composite, clamped")
def composite(t):  # noqa: ANN001, ANN201
    return t("lineitem").select("l_orderkey", "l_linenumber", S.composite_salience(F.col("l_discount"), F.col("l_tax")).alias("composite"), S.clamp(F.col("l_discount") * 20.0).alias("clamped"))


@query("tiered_decay", f"SELECT event_id, 0.5e0 * exp(-ln(2e0) * ({AGE}) / 24) + 0.3e0 * exp(-ln(2e0) * ({AGE}) / 168) + 0.2e0 * exp(-ln(2e0) * ({AGE}) / 720) AS decay, exp(-0.693e0 * ({AGE}) / 720) AS proximity FROM tag_events", "decay, proximity")
def tiers(t):  # noqa: ANN001, ANN201
    age = S.hours_between(F.lit(P.now).cast("timestamp"), F.col("occurred_at"))
    return t("tag_events").select("event_id", S.tiered_decay(age).alias("decay"), S.temporal_proximity(age).alias("proximity"))


@query("effective_strength", "SELECT event_id, value * least(1e0 + 0.15e0 * (event_id % 20), 3e0) AS strength FROM tag_events", "strength")
def effective(t):  # noqa: ANN001, ANN201
    return t("tag_events").select("event_id", S.effective_strength(F.col("value"), F.col("event_id") % 20).alias("strength"))


# ---- memories and tags --------------------------------------------------------------------------


@query("get_by_id", "SELECT memory_id, source_model FROM memories WHERE memory_id IN (1, 7, 77, 777)")
def get_by_id(t):  # noqa: ANN001, ANN201
    return M.by_id(t("memories"), [1, 7, 77, 777], "memory_id").select("memory_id", "source_model")


@query("list_recent", "SELECT memory_id, source_model FROM memories WHERE NOT is_archived ORDER BY created_at DESC, memory_id LIMIT 20")
def list_recent(t):  # noqa: ANN001, ANN201
    return M.list_recent(t("memories")).select("memory_id", "source_model")


@query("count_active", "SELECT count(*) AS active_memories FROM memories WHERE NOT is_archived")
def count_active(t):  # noqa: ANN001, ANN201
    return M.count_active(t("memories"))


@query("archive", "SELECT memory_id, is_archived OR memory_id % 10 = 0 AS is_archived FROM memories")
def archive(t):  # noqa: ANN001, ANN201
    return M.archive(t("memories"), t("memories").filter("memory_id % 10 = 0")).select("memory_id", "is_archived")


@query("retrieve_by_any_tag", "SELECT memory_id FROM memories WHERE NOT is_archived AND memory_id IN (SELECT memory_id FROM memory_tags WHERE tag_id IN (1, 2, 3))")
def any_tag(t):  # noqa: ANN001, ANN201
    return M.retrieve_by_tags(t("memories"), t("memory_tags"), [1, 2, 3]).select("memory_id")


@query("retrieve_by_all_tags", "SELECT memory_id FROM memories WHERE NOT is_archived AND memory_id IN (SELECT memory_id FROM memory_tags WHERE tag_id IN (1, 2) GROUP BY memory_id HAVING count(DISTINCT tag_id) = 2)")
def all_tags(t):  # noqa: ANN001, ANN201
    return M.retrieve_by_tags(t("memories"), t("memory_tags"), [1, 2], match_all=True).select("memory_id")


@query("tags_of_memories", "SELECT memory_id, array_to_string(list_sort(list(DISTINCT tag_id)), ',') AS tag_ids, count(DISTINCT tag_id) AS tag_count FROM memory_tags GROUP BY memory_id")
def tags_of(t):  # noqa: ANN001, ANN201
    return M.tags_of_memories(t("memory_tags")).withColumn("tag_ids", F.array_join("tag_ids", ","))


_NORM = "regexp_replace(regexp_replace(lower(trim({})), '\\s+', '-', 'g'), '[^a-z0-9\\-:]', '', 'g')"


@query("normalize_tag", f"SELECT p_partkey, {_NORM.format('p_type')} AS of_type, {_NORM.format('p_name')} AS of_name FROM part")
def normalize(t):  # noqa: ANN001, ANN201
    return t("part").select("p_partkey", S.normalize_tag(F.col("p_type")).alias("of_type"), S.normalize_tag(F.col("p_name")).alias("of_name"))


@query("get_or_create_tags", f"SELECT DISTINCT {_NORM.format('p_brand')} AS name FROM part WHERE {_NORM.format('p_brand')} NOT IN (SELECT {_NORM.format('p_brand')} FROM part WHERE p_partkey < 5)")
def get_or_create(t):  # noqa: ANN001, ANN201
    have = t("part").filter("p_partkey < 5").select(S.normalize_tag(F.col("p_brand")).alias("name"))
    return M.get_or_create_tags(have, t("part").select(F.col("p_brand").alias("name")))


@query("split_compound_tags", f"SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array({_NORM.format('p_name')}, '[-_]')) AS name FROM part) WHERE length(name) > 1 AND NOT regexp_matches(name, '^[0-9]+$')")
def compounds(t):  # noqa: ANN001, ANN201
    return M.split_compounds(t("part").select(S.normalize_tag(F.col("p_name")).alias("name")).filter("name like '%-%'").unionByName(t("part").select(S.normalize_tag(F.col("p_name")).alias("name")).filter("name not like '%-%'").limit(0)))


@query("letter_tags", "SELECT p_partkey AS memory_id, letter, CAST(count(*) AS DOUBLE) AS confidence FROM (SELECT p_partkey, unnest(string_split(lower(p_name), '')) AS letter FROM part) WHERE regexp_matches(letter, '^[a-z]$') GROUP BY 1, 2", "confidence")
def letters(t):  # noqa: ANN001, ANN201
    return M.letter_tags(t("part"), "p_partkey", "p_name").withColumnRenamed("p_partkey", "memory_id")


@query("time_tags", "SELECT memory_id, unnest(['month-' || strftime(created_at, '%m'), 'day-' || strftime(created_at, '%d'), 'minute-' || strftime(created_at, '%M')]) AS name FROM memories")
def times(t):  # noqa: ANN001, ANN201
    return M.time_tags(t("memories"))


_TENSOR_MAX = ", ".join(f"max({c}) AS {c}" for c in ("cooccurrence", "synchronicity", "semantic", "glyph", "semiotic_forward", "semiotic_reverse"))


@query(
    "merge_tags",
    f"""SELECT tag_a_id, tag_b_id, {_TENSOR_MAX} FROM (SELECT least(a, b) AS tag_a_id, greatest(a, b) AS tag_b_id, cooccurrence, synchronicity, semantic, glyph,
        CASE WHEN a > b THEN semiotic_reverse ELSE semiotic_forward END AS semiotic_forward, CASE WHEN a > b THEN semiotic_forward ELSE semiotic_reverse END AS semiotic_reverse
        FROM (SELECT *, CASE WHEN tag_a_id = 3 THEN 60 ELSE tag_a_id END AS a, CASE WHEN tag_b_id = 3 THEN 60 ELSE tag_b_id END AS b FROM tensor) WHERE a <> b) GROUP BY 1, 2""",
    "cooccurrence, synchronicity, semantic, glyph, semiotic_forward, semiotic_reverse",
)
def merge(t):  # noqa: ANN001, ANN201
    return M.merge_tags(t("tensor"), 3, 60)


@query("merge_memory_tags", "SELECT DISTINCT memory_id, CASE WHEN tag_id = 3 THEN 40 ELSE tag_id END AS tag_id FROM memory_tags")
def merge_rows(t):  # noqa: ANN001, ANN201
    return M.merge_memory_tags(t("memory_tags"), 3, 40)


@query("keep_strongest", "SELECT event_id, tag_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, tag_id ORDER BY value DESC, occurred_at DESC, event_id) AS r FROM tag_events) WHERE r = 1", "value")
def strongest(t):  # noqa: ANN001, ANN201
    return M.keep_strongest(t("tag_events").withColumnsRenamed({"value": "strength", "occurred_at": "detected_at"}), ["event_type", "tag_id"]).select("event_id", "tag_id", "event_type", F.col("strength").alias("value"))


@query("min_max", "SELECT o_orderkey, CASE WHEN hi - lo < 1e-9 THEN 0.5e0 ELSE (o_totalprice - lo) / (hi - lo) END AS scaled FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)", "scaled")
def scaled(t):  # noqa: ANN001, ANN201
    return M.min_max(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "scaled").select("o_orderkey", "scaled")


@query("rank_results", "SELECT retrieval_id, memory_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY score DESC, memory_id) AS rank FROM results")
def ranks(t):  # noqa: ANN001, ANN201
    return M.ranked(t("results"), ["retrieval_id"], "score", "memory_id").select("retrieval_id", "memory_id", "rank")


_TOP = "(SELECT * FROM (SELECT c_custkey AS memory_id, c_acctbal AS score, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE {}) WHERE r <= 100)"


@query(
    "compare_traces",
    f"""SELECT coalesce(a.memory_id, b.memory_id) AS memory_id, a.score AS score_before, b.score AS score_after, b.score - a.score AS score_shift, a.r - b.r AS rank_shift,
        CASE WHEN a.memory_id IS NULL THEN 'added' WHEN b.memory_id IS NULL THEN 'removed' ELSE 'both' END AS found_in FROM {_TOP.format('c_custkey % 3 <> 0')} a FULL JOIN {_TOP.format('c_custkey % 4 <> 0')} b ON a.memory_id = b.memory_id""",
    "score_before, score_after, score_shift",
)
def traces(t):  # noqa: ANN001, ANN201
    c = t("customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_acctbal").alias("score"))
    a, b = (c.filter(f"memory_id % {n} <> 0").orderBy(F.col("score").desc(), "memory_id").limit(100) for n in (3, 4))
    return M.compare_traces(a, b)


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def hashes(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


@query("block_keys", "SELECT memory_id, substr(sha256(string_agg(s, ',' ORDER BY s)), 1, 32) AS block_key FROM (SELECT DISTINCT memory_id, CAST(tag_id AS VARCHAR) AS s FROM memory_tags) GROUP BY memory_id")
def keys(t):  # noqa: ANN001, ANN201
    return t("memory_tags").groupBy("memory_id").agg(F.collect_set("tag_id").alias("s")).select("memory_id", S.key_of(F.col("s")).alias("block_key"))


# ---- pairs of tags ------------------------------------------------------------------------------

_PAIRS = "(SELECT x.tag_id AS tag_a_id, y.tag_id AS tag_b_id, count(*) AS cnt FROM {0} x JOIN {0} y ON x.{1} = y.{1} AND x.tag_id < y.tag_id GROUP BY 1, 2)"
_COUNTS = "(SELECT tag_id, count(*) AS n FROM {0} GROUP BY 1)"


def _pmi_sql(table: str, key: str) -> str:
    return f"""(SELECT tag_a_id, tag_b_id, cnt, ln(cnt * total / (CAST(a.n AS DOUBLE) * b.n)) AS pmi FROM {_PAIRS.format(table, key)} p JOIN {_COUNTS.format(table)} a ON a.tag_id = tag_a_id JOIN {_COUNTS.format(table)} b ON b.tag_id = tag_b_id,
        (SELECT count(DISTINCT {key}) AS total FROM {table}) WHERE cnt >= 2 AND total >= 2 AND ln(cnt * total / (CAST(a.n AS DOUBLE) * b.n)) > 0)"""


@query("cooccurrence", f"SELECT * FROM {_PAIRS.format('memory_tags', 'memory_id')}")
def cooccurrence(t):  # noqa: ANN001, ANN201
    return C.item_pairs(t("memory_tags"), "memory_id")


@query("pmi", f"SELECT * FROM {_pmi_sql('memory_tags', 'memory_id')}", "pmi")
def pmi(t):  # noqa: ANN001, ANN201
    return C.pmi(t("memory_tags"), "memory_id")


@query("combined_cooccurrence", f"SELECT coalesce(m.tag_a_id, r.tag_a_id) AS tag_a_id, coalesce(m.tag_b_id, r.tag_b_id) AS tag_b_id, coalesce(m.pmi, 0e0) + coalesce(r.pmi, 0e0) AS cooccurrence FROM {_pmi_sql('user_tags', 'memory_id')} m FULL JOIN {_pmi_sql('session_tags', 'retrieval_id')} r ON m.tag_a_id = r.tag_a_id AND m.tag_b_id = r.tag_b_id", "cooccurrence")
def combined(t):  # noqa: ANN001, ANN201
    return C.combined_cooccurrence(t("user_tags"), t("session_tags"))


def _share_sql(table: str, key: str, least: int) -> str:
    return f"(SELECT tag_a_id, tag_b_id, cnt / CAST(a.n AS DOUBLE) AS f, cnt / CAST(b.n AS DOUBLE) AS r FROM {_PAIRS.format(table, key)} JOIN {_COUNTS.format(table)} a ON a.tag_id = tag_a_id JOIN {_COUNTS.format(table)} b ON b.tag_id = tag_b_id WHERE cnt >= {least})"


@query("conditional_probability", f"SELECT coalesce(m.tag_a_id, s.tag_a_id) AS tag_a_id, coalesce(m.tag_b_id, s.tag_b_id) AS tag_b_id, coalesce(m.f, 0) + coalesce(s.f, 0) AS semiotic_forward, coalesce(m.r, 0) + coalesce(s.r, 0) AS semiotic_reverse FROM {_share_sql('user_tags', 'memory_id', 1)} m FULL JOIN {_share_sql('session_tags', 'retrieval_id', 2)} s ON m.tag_a_id = s.tag_a_id AND m.tag_b_id = s.tag_b_id", "semiotic_forward, semiotic_reverse")
def conditional(t):  # noqa: ANN001, ANN201
    return C.conditional(t("user_tags"), t("session_tags"))


def _ppmi_sql(table: str, key: str, scope: str) -> str:
    return f"""(SELECT tag_a_id, tag_b_id, '{scope}' AS scope, cnt, a.n * CAST(b.n AS DOUBLE) / total AS expected, greatest(0e0, ln(cnt / (a.n * CAST(b.n AS DOUBLE) / total))) AS ppmi FROM {_PAIRS.format(table, key)} JOIN {_COUNTS.format(table)} a ON a.tag_id = tag_a_id JOIN {_COUNTS.format(table)} b ON b.tag_id = tag_b_id, (SELECT greatest(count(DISTINCT {key}), 1) AS total FROM {table}))"""


@query("ppmi", f"SELECT * FROM {_ppmi_sql('user_tags', 'memory_id', 'store')}", "expected, ppmi")
def ppmi(t):  # noqa: ANN001, ANN201
    return C.ppmi(t("user_tags"), "memory_id", "store")


_STRONGEST = f"(SELECT tag_a_id, tag_b_id, max(ppmi) AS strength FROM (SELECT * FROM {_ppmi_sql('user_tags', 'memory_id', 'store')} UNION ALL SELECT * FROM {_ppmi_sql('session_tags', 'retrieval_id', 'retrieval')}) GROUP BY 1, 2)"


@query("strongest_scope", f"SELECT * FROM {_STRONGEST}", "strength")
def strongest_scope(t):  # noqa: ANN001, ANN201
    return C.strongest_scope(C.ppmi(t("user_tags"), "memory_id", "store").unionByName(C.ppmi(t("session_tags"), "retrieval_id", "retrieval")))


@query("block_density", f"SELECT x.retrieval_id AS memory_id, avg(strength) AS density, count(*) AS pairs FROM session_tags x JOIN session_tags y ON x.retrieval_id = y.retrieval_id AND x.tag_id < y.tag_id JOIN {_STRONGEST} e ON e.tag_a_id = x.tag_id AND e.tag_b_id = y.tag_id GROUP BY 1", "density")
def block_density(t):  # noqa: ANN001, ANN201
    return C.blocks(strongest_scope(t), t("session_tags").withColumnRenamed("retrieval_id", "memory_id"))


@query("block_membership", f"SELECT memory_id, tag_id, s / (n - 1) AS membership FROM (SELECT x.retrieval_id AS memory_id, x.tag_id, sum(strength) AS s FROM session_tags x JOIN session_tags y ON x.retrieval_id = y.retrieval_id AND x.tag_id <> y.tag_id JOIN {_STRONGEST} e ON e.tag_a_id = least(x.tag_id, y.tag_id) AND e.tag_b_id = greatest(x.tag_id, y.tag_id) GROUP BY 1, 2) JOIN (SELECT retrieval_id AS memory_id, count(*) AS n FROM session_tags GROUP BY 1 HAVING count(*) > 1) USING (memory_id)", "membership")
def membership(t):  # noqa: ANN001, ANN201
    return C.block_membership(strongest_scope(t), t("session_tags").withColumnRenamed("retrieval_id", "memory_id"))


@query("edge_ema", "SELECT tag_a_id, tag_b_id, cnt, 1e0 - power(0.85e0, cnt) AS strength FROM pairs", "strength")
def edge_ema(t):  # noqa: ANN001, ANN201
    return T.edge_ema(t("pairs"))


@query("upper_median", "SELECT cnt AS median FROM (SELECT cnt, row_number() OVER (ORDER BY cnt) - 1 AS i, count(*) OVER () AS n FROM pairs) WHERE i = n // 2")
def upper_median(t):  # noqa: ANN001, ANN201
    return C.upper_median(t("pairs"), "cnt")


_BLOCKS = "(SELECT DISTINCT user_id % 40 AS block_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS tag_id FROM events WHERE event_type = 'signup')"
_ACTS = "(SELECT DISTINCT user_id % 40 AS block_id, CAST(extract(day FROM ts) AS BIGINT) AS retrieval_id FROM events WHERE event_type = 'purchase')"
_FREQ = "(SELECT tag_id, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS freq FROM tag_events GROUP BY 1)"
_BRIDGES = f"""(WITH m AS {_BLOCKS}, act AS {_ACTS}, fr AS {_FREQ},
    sh AS (SELECT DISTINCT x.block_id AS l, y.block_id AS r FROM m x JOIN m y ON x.tag_id = y.tag_id AND x.block_id < y.block_id),
    n AS (SELECT block_id, count(*) AS n FROM m GROUP BY 1), runs AS (SELECT block_id, count(*) AS n FROM act GROUP BY 1),
    common AS (SELECT x.block_id AS l, y.block_id AS r, count(*) AS c FROM act x JOIN act y ON x.retrieval_id = y.retrieval_id AND x.block_id < y.block_id GROUP BY 1, 2),
    inter AS (SELECT x.block_id AS l, y.block_id AS r, count(*) AS i FROM m x JOIN m y ON x.tag_id = y.tag_id AND x.block_id < y.block_id GROUP BY 1, 2),
    rar AS (SELECT block_id, avg(freq) AS f FROM m JOIN fr USING (tag_id) GROUP BY 1),
    deg AS (SELECT b AS block_id, count(*) AS d FROM (SELECT l AS b FROM sh UNION ALL SELECT r FROM sh) GROUP BY 1),
    med AS (SELECT d AS median FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM deg) WHERE i = n // 2),
    j AS (SELECT sh.l, sh.r, i / CAST(nl.n + nr.n - i AS DOUBLE) AS jac, CASE WHEN least(coalesce(rl.n, 0), coalesce(rr.n, 0)) > 0 THEN coalesce(c, 0) / CAST(least(rl.n, rr.n) AS DOUBLE) ELSE 0e0 END AS share,
        (coalesce(fl.f, 0) + coalesce(fr2.f, 0)) / 2 AS f, greatest(0, greatest(dl.d, dr.d) - median) AS ex
      FROM sh JOIN inter USING (l, r) JOIN n nl ON nl.block_id = sh.l JOIN n nr ON nr.block_id = sh.r LEFT JOIN runs rl ON rl.block_id = sh.l LEFT JOIN runs rr ON rr.block_id = sh.r LEFT JOIN common cm ON cm.l = sh.l AND cm.r = sh.r
      LEFT JOIN rar fl ON fl.block_id = sh.l LEFT JOIN rar fr2 ON fr2.block_id = sh.r JOIN deg dl ON dl.block_id = sh.l JOIN deg dr ON dr.block_id = sh.r, med),
    s AS (SELECT l, r, (0.5e0 * jac + 0.5e0 * share) * (1 - jac) * (1 / (1 + 10 * f)) * (1 / (1 + 0.5e0 * ex)) AS bridge FROM j),
    e AS (SELECT l AS b, l, r, bridge FROM s WHERE bridge > 0 UNION ALL SELECT r, l, r, bridge FROM s WHERE bridge > 0)
    SELECT DISTINCT l, r, bridge FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY bridge DESC, l, r) AS k FROM e) WHERE k <= 5)"""


def _blocks_of(t) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    e = t("events")
    tag = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS tag_id"
    members = e.filter("event_type = 'signup'").selectExpr("user_id % 40 AS block_id", tag).distinct()
    acts = e.filter("event_type = 'purchase'").selectExpr("user_id % 40 AS block_id", "CAST(extract(day FROM ts) AS BIGINT) AS retrieval_id").distinct()
    total = e.agg(F.count(F.lit(1)).alias("_n"))
    freq = t("tag_events").groupBy("tag_id").agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(total)).select("tag_id", (F.col("_c") / F.col("_n")).alias("freq"))
    return members, acts, freq


@query("bridge_scores", f"SELECT * FROM {_BRIDGES}", "bridge")
def bridges(t):  # noqa: ANN001, ANN201
    return C.bridge_scores(*_blocks_of(t))


@query("bridge_sum", f"SELECT block_id, sum(bridge) AS bridge_strength FROM (SELECT l AS block_id, bridge FROM {_BRIDGES} UNION ALL SELECT r, bridge FROM {_BRIDGES}) GROUP BY 1", "bridge_strength")
def bridge_sum(t):  # noqa: ANN001, ANN201
    return C.bridge_sum(bridges(t))


@query("tag_pair_bridges", f"SELECT least(x.tag_id, y.tag_id) AS tag_a_id, greatest(x.tag_id, y.tag_id) AS tag_b_id, max(bridge) AS bridge FROM {_BRIDGES} b JOIN {_BLOCKS} x ON x.block_id = l JOIN {_BLOCKS} y ON y.block_id = r WHERE x.tag_id <> y.tag_id GROUP BY 1, 2", "bridge")
def pair_bridges(t):  # noqa: ANN001, ANN201
    return C.tag_pair_bridges(_blocks_of(t)[0], bridges(t))


@query("bridged_pmi", f"SELECT p.tag_a_id, p.tag_b_id, cnt, pmi, bridge, pmi + coalesce(bridge, 0e0) AS weight FROM {_pmi_sql('user_tags', 'memory_id')} p LEFT JOIN (SELECT least(x.tag_id, y.tag_id) AS tag_a_id, greatest(x.tag_id, y.tag_id) AS tag_b_id, max(bridge) AS bridge FROM {_BRIDGES} b JOIN {_BLOCKS} x ON x.block_id = l JOIN {_BLOCKS} y ON y.block_id = r WHERE x.tag_id <> y.tag_id GROUP BY 1, 2) q ON p.tag_a_id = q.tag_a_id AND p.tag_b_id = q.tag_b_id WHERE pmi + coalesce(bridge, 0e0) >= 0.1", "pmi, bridge, weight")
def bridged(t):  # noqa: ANN001, ANN201
    return C.bridged_pmi(C.pmi(t("user_tags"), "memory_id"), pair_bridges(t))


# ---- lattice ------------------------------------------------------------------------------------

_ANGLE = "CAST(CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616e0 * " + repr(2 * math.pi)
_BRAND_ANGLES = f"(SELECT id, name, {_ANGLE.format('name')} AS angle FROM brands)"
PRIMES = L.first_primes(P.glyph_primes)
_SLOTS = f"(SELECT id, prime, CAST(CAST(floor(angle * prime / {2 * math.pi!r}) AS BIGINT) % prime AS INT) AS slot FROM {_BRAND_ANGLES}, (SELECT unnest({PRIMES}) AS prime))"
_RES = f"(SELECT a, b, count(*) AS shared_count, sum(ln(prime)) AS strength, exp(-sum(ln(prime))) AS chance FROM (SELECT x.id AS a, y.id AS b, x.prime FROM {_SLOTS} x JOIN {_SLOTS} y ON x.prime = y.prime AND x.slot = y.slot AND x.id < y.id) GROUP BY 1, 2 HAVING count(*) >= 6)"


def _angles(t):  # noqa: ANN001, ANN202
    return L.place_names(t("brands"))


@query("hash_angle", f"SELECT * FROM {_BRAND_ANGLES}", "angle")
def angles(t):  # noqa: ANN001, ANN201
    return _angles(t).select("id", "name", "angle")


@query("prime_slots", f"SELECT * FROM {_SLOTS}")
def prime_slots(t):  # noqa: ANN001, ANN201
    return L.slots(_angles(t), PRIMES)


@query("slot_populations", f"SELECT prime, slot, count(*) AS population FROM {_SLOTS} GROUP BY 1, 2")
def populations(t):  # noqa: ANN001, ANN201
    return L.slot_populations(L.slots(_angles(t), PRIMES))


@query("find_resonances", f"SELECT * FROM {_RES}", "strength, chance")
def find_resonances(t):  # noqa: ANN001, ANN201
    return L.resonances(L.slots(_angles(t), PRIMES), 6)


_NEAR = f"(SELECT r.* FROM {_RES} r JOIN {_BRAND_ANGLES} x ON x.id = a JOIN {_BRAND_ANGLES} y ON y.id = b WHERE least(abs(x.angle - y.angle), {2 * math.pi!r} - abs(x.angle - y.angle)) <= {L.proximity_threshold(PRIMES, 6)!r})"


@query("persist_resonances", f"SELECT n.* FROM {_NEAR} n JOIN (SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY strength DESC, a, b) AS k FROM (SELECT a AS e, a, b, strength FROM {_NEAR} UNION ALL SELECT b, a, b, strength FROM {_NEAR})) WHERE k <= 30) USING (a, b)", "strength, chance")
def persist(t):  # noqa: ANN001, ANN201
    return L.persist_resonances(_angles(t), P, glyph=True)


@query("parallelness", f"SELECT a, b, cos(x.angle - y.angle) AS parallelness FROM {_RES} r JOIN {_BRAND_ANGLES} x ON x.id = a JOIN {_BRAND_ANGLES} y ON y.id = b", "parallelness")
def parallelness(t):  # noqa: ANN001, ANN201
    return L.parallelness(find_resonances(t), _angles(t))


@query(
    "void_profile",
    f"""WITH c AS (SELECT atan2(sum(sin(angle)), sum(cos(angle))) AS raw, count(*) AS n FROM {_BRAND_ANGLES}), m AS (SELECT CASE WHEN raw < 0 THEN raw + {2 * math.pi!r} ELSE raw END AS centre, n FROM c),
        d AS (SELECT id, centre, n, row_number() OVER (ORDER BY least(abs(angle - centre), {2 * math.pi!r} - abs(angle - centre)), id) AS k FROM {_BRAND_ANGLES}, m)
        SELECT p_size AS tag_id, centre AS void_angle, count(*) AS cnt FROM d JOIN (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS id, p_size FROM part) USING (id) WHERE k <= greatest(1, floor(0.3 * n)) GROUP BY 1, 2 ORDER BY cnt DESC, tag_id LIMIT 10""",
    "void_angle",
)
def void(t):  # noqa: ANN001, ANN201
    tags = t("part").selectExpr("CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS id", "p_size AS tag_id").distinct()
    return L.void_profile(_angles(t), tags)


@query("ramsey_depth", f"SELECT id, least(0.95e0, 0.6e0 * (0.5e0 + 1 / (1 + exp(m)))) AS radius FROM (SELECT s.id, avg(ln(p.population * CAST(s.prime AS DOUBLE) / n)) AS m FROM {_SLOTS} s JOIN (SELECT prime, slot, count(*) AS population FROM {_SLOTS} GROUP BY 1, 2) p USING (prime, slot), (SELECT count(*) AS n FROM brands) GROUP BY 1)", "radius")
def ramsey(t):  # noqa: ANN001, ANN201
    at = _angles(t).withColumn("radius", F.lit(0.6))
    return L.ramsey_depth(L.slots(at, PRIMES), at)


@query("lattice_state", f"SELECT a, b, shared_count, strength, x.name AS name_a, y.name AS name_b FROM {_RES} r JOIN brands x ON x.id = a JOIN brands y ON y.id = b ORDER BY round(strength, 6) DESC, a, b LIMIT 50", "strength")
def lattice_state(t):  # noqa: ANN001, ANN201
    return L.strongest_resonances(rounded(find_resonances(t)), t("brands")).select("a", "b", "shared_count", "strength", "name_a", "name_b")


@query("poincare", "SELECT event_id, acosh(greatest(1e0, 1e0 + 2e0 * ((x - y) * (x - y)) / ((1 - x * x) * (1 - y * y)))) AS distance, 2e0 / (1 - x * x) AS factor, tanh(x) AS mapped FROM (SELECT event_id, value / 1000e0 AS x, (event_id % 50) / 100e0 AS y FROM tag_events)", "distance, factor, mapped")
def poincare(t):  # noqa: ANN001, ANN201
    x, y = F.array(F.col("value") / 1000.0, F.lit(0.0)), F.array((F.col("event_id") % 50) / F.lit(100.0), F.lit(0.0))
    return t("tag_events").select("event_id", S.ball_distance(x, y).alias("distance"), S.conformal_factor(x).alias("factor"), F.element_at(S.exp_origin(x), 1).alias("mapped"))


# ---- vectors ------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_QUERIES = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"
_SCORES = f"(SELECT query_id, vec_id AS memory_id, label, {_DOT.format('q', 'embedding')} AS score FROM embeddings, {_QUERIES})"


def all_queries(t):  # noqa: ANN001, ANN202
    """Every row whose id is divisible by 20."""
    return t("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_top_k", f"SELECT query_id, memory_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM {_SCORES}) WHERE rank <= 10 AND score >= 0.1", "score")
def vector_top_k(t):  # noqa: ANN001, ANN201
    return VS.top_k_blocks(all_queries(t), t("vectors"), 10, 0.1).select("query_id", "memory_id", "score", "rank")


@query("retrieve_semantic", f"SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS r FROM {_SCORES}) WHERE r <= 50 AND label < 5 QUALIFY rank <= 10", "score")
def semantic(t):  # noqa: ANN001, ANN201
    return VS.retrieve_semantic(all_queries(t), t("vectors"), 10, t("vectors").filter("tag_id < 5"), VS.top_k_blocks).select("query_id", "memory_id", "score", "rank")


_MEANS = "(SELECT label AS tag_id, i AS position, avg(CAST(embedding[i + 1] AS DOUBLE)) AS mean FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2)"


@query("tag_centroids", f"SELECT tag_id, CAST(position AS INT) AS position, mean / sqrt(sum(mean * mean) OVER (PARTITION BY tag_id)) AS x FROM {_MEANS}", "x")
def tag_centroids(t):  # noqa: ANN001, ANN201
    return VS.centroids(t("vectors"), "tag_id").select("tag_id", F.posexplode("centroid").alias("position", "x"))


@query("centroid_neighbours", f"SELECT a, b, similarity FROM (SELECT x.tag_id AS a, y.tag_id AS b, sum(x.u * y.u) AS similarity FROM (SELECT tag_id, position, mean / sqrt(sum(mean * mean) OVER (PARTITION BY tag_id)) AS u FROM {_MEANS}) x JOIN (SELECT tag_id, position, mean / sqrt(sum(mean * mean) OVER (PARTITION BY tag_id)) AS u FROM {_MEANS}) y ON x.position = y.position AND x.tag_id <> y.tag_id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 3", "similarity")
def centroid_neighbours(t):  # noqa: ANN001, ANN201
    c = VS.centroids(t("vectors"), "tag_id").select(F.col("tag_id").alias("id"), F.col("centroid").alias("v"))
    return VS.neighbours(c, c, -1.0, 3)


@query(
    "semantic_convergence",
    f"""WITH r AS (SELECT vec_id // 10 AS retrieval_id, vec_id AS memory_id, label, embedding FROM embeddings QUALIFY dense_rank() OVER (ORDER BY vec_id // 10 DESC) <= 20)
        SELECT x.memory_id AS memory_a, y.memory_id AS memory_b, {_DOT.format('x.embedding', 'y.embedding')} AS similarity FROM r x JOIN r y ON x.memory_id < y.memory_id AND x.retrieval_id <> y.retrieval_id AND x.label <> y.label WHERE {_DOT.format('x.embedding', 'y.embedding')} >= 0.2""",
    "similarity",
)
def convergence(t):  # noqa: ANN001, ANN201
    v = t("vectors").withColumn("retrieval_id", F.floor(F.col("memory_id") / 10))
    return VS.semantic_convergence(v.select("retrieval_id", F.timestamp_seconds("retrieval_id").alias("occurred_at"), "memory_id"), t("vectors"), t("vectors"), 20, 0.2)


@query("cell_search")
def cell_search(t):  # noqa: ANN001, ANN201
    return VS.cell_search(all_queries(t), t("vectors"), 10)


from tagloom.plans import catalog_graph  # noqa: E402, F401  registers its queries
