"""Walks over a deep graph with shared nodes, cycles and large ordinals, each with its oracle.

The graph is made from `part`: blocks of 13 parts, each part made from the next and the one after it in its block; in every
fifth block the last is made from the first, which closes a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.operators import dag
from reminisce.operators.compact import Store
from reminisce.sources.tables import table

_GRAPH = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey // 13 AS b, p_partkey % 13 AS i FROM part),
s AS (SELECT 'n' || k AS summary_id, b, i, CASE WHEN b % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.b = p.b AND q.i > p.i) THEN 'leaf' ELSE 'condensed' END AS kind, (k % 7 + 1)::BIGINT AS token_count FROM p),
e AS (
  SELECT 'n' || x.k AS derived_id, 'n' || y.k AS source_id, (9997 + 2 * (y.k - x.k))::BIGINT AS ordinal FROM p x JOIN p y ON x.b = y.b AND y.k - x.k IN (1, 2)
  UNION ALL SELECT 'n' || max(k), 'n' || min(k), 12345 FROM p WHERE b % 5 = 0 GROUP BY b HAVING count(*) > 1)"""

_PATHS = f"""{_GRAPH},
w AS (
  SELECT summary_id AS root, summary_id AS node, 0::BIGINT AS level, '' AS path, []::BIGINT[] AS places, [summary_id] AS seen FROM s WHERE i < 3
  UNION ALL
  SELECT w.root, e.source_id, w.level + 1, w.path || '.' || format('{{:04d}}', e.ordinal), list_append(w.places, e.ordinal), list_append(w.seen, e.source_id) FROM w JOIN e ON e.derived_id = w.node WHERE NOT list_contains(w.seen, e.source_id))"""


def graph(spark: SparkSession, sf_dir: str) -> Store:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")).withColumns({"b": F.floor(F.col("k") / 13), "i": F.col("k") % 13})
    ends = p.groupBy("b").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    kind = F.when((F.col("b") % 5 != 0) & (F.col("k") == F.col("last")), "leaf").otherwise("condensed")
    s = p.join(ends, "b").select(name("k").alias("summary_id"), F.col("b").alias("conversation_id"), "i", kind.alias("kind"), (F.col("k") % 7 + 1).alias("token_count"))
    q = p.select(F.col("k").alias("to"), F.col("b").alias("c"))
    near = p.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("to", F.col("k") + F.col("step")).join(q, "to").filter("b = c")
    e = near.select(name("k").alias("derived_id"), name("to").alias("source_id"), (9997 + 2 * F.col("step")).cast("long").alias("ordinal"))
    back = ends.filter("b % 5 = 0 and first < last").select(name("last").alias("derived_id"), name("first").alias("source_id"), F.lit(12345).cast("long").alias("ordinal"))
    none = spark.createDataFrame([], "summary_id string, message_id long, ordinal long")
    m = spark.createDataFrame([], "message_id long, seq long, token_count long, created_at timestamp")
    return Store(m, s, none, e.unionByName(back), None)


def deep_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.reachable(graph(spark, sf_dir)).select("summary_id", "n_sources")


def deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dag.walk(g.summary_edges, g.summaries.filter("i < 3")).select("root", "node", "level", "path")


def deep_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dag.expand(g, g.summaries.filter("i < 3"), 200, include_messages=False).select("root", "place", "node", "cum")


def deep_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return dag.backfill_depth(g.summaries, g.summary_edges)


def deep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    acyclic = g.summaries.filter("conversation_id % 5 != 0")
    return dag.rollup(Store(g.messages, acyclic, g.summary_messages, g.summary_edges.join(acyclic.select(F.col("summary_id").alias("derived_id")), "derived_id", "left_semi"), None)).select("summary_id", "descendant_count", "descendant_token_count")


_ORACLES = {
    "deep_reachable": f"{_GRAPH}, r AS (SELECT summary_id AS root, summary_id AS node FROM s UNION SELECT r.root, e.source_id FROM r JOIN e ON e.derived_id = r.node) SELECT root AS summary_id, count(*) - 1 AS n_sources FROM r GROUP BY 1",
    "deep_paths": f"{_PATHS} SELECT root, node, level, path FROM w",
    "deep_expand": f"{_PATHS} SELECT root, place, node, cum FROM (SELECT root, node, row_number() OVER o AS place, sum(token_count) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM w JOIN s ON s.summary_id = w.node WHERE level > 0 WINDOW o AS (PARTITION BY root ORDER BY places)) WHERE cum <= 200",
    "deep_backfill": f"{_GRAPH}, v AS (SELECT summary_id AS root, summary_id AS node, 0 AS level FROM s WHERE b % 5 <> 0 UNION SELECT v.root, e.source_id, v.level + 1 FROM v JOIN e ON e.derived_id = v.node) SELECT summary_id, (CASE WHEN b % 5 = 0 THEN 1 ELSE (SELECT max(level) FROM v WHERE root = summary_id) END)::BIGINT AS depth FROM s",
    "deep_rollup": f"{_GRAPH}, v AS (SELECT summary_id AS root, summary_id AS node, 0 AS level FROM s WHERE b % 5 <> 0 UNION ALL SELECT v.root, e.source_id, v.level + 1 FROM v JOIN e ON e.derived_id = v.node) SELECT root AS summary_id, count(*) FILTER (level > 0) AS descendant_count, coalesce(sum(token_count) FILTER (level > 0), 0)::BIGINT AS descendant_token_count FROM v JOIN s ON s.summary_id = node GROUP BY 1",
}


def queries() -> dict:
    return {f.__name__: f for f in (deep_reachable, deep_paths, deep_expand, deep_backfill, deep_rollup)}


def oracle_sql() -> dict[str, str]:
    return _ORACLES
