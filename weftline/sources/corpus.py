"""Corpus views over the driver's tables, as SQL that Spark and DuckDB both run.

``{table}`` stands for a table; ``spark_view`` fills in DataFrames, ``duck_view`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every document as a file; the suffix goes round eight kinds.
DOC_FILES = """
SELECT 'src/' || source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || CASE doc_id % 8
  WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.sh' WHEN 4 THEN '.tf' WHEN 5 THEN '.rs' WHEN 6 THEN '.java' ELSE '.md' END AS path,
  coalesce(text, '') AS source, doc_id AS file_ord, source AS repo
FROM {documents}
"""
#: A Python source for every part: two imports, a class with a base and a decorator, functions.
CODE_FILES = """
SELECT k AS file_ord, 'src/b' || CAST(k % 25 AS STRING) || '/p' || CAST(k % 7 AS STRING) || '/' || CASE WHEN k % 10 = 3 THEN 'test_' ELSE '' END || 'part_' || CAST(k AS STRING) || '.py' AS path,
  'from part_' || CAST(a AS STRING) || ' import f_' || CAST(a AS STRING) || chr(10) || 'import part_' || CAST(b AS STRING) || chr(10) || chr(10)
  || CASE WHEN k % 6 = 0 THEN 'plug = importlib.import_module("part_' || CAST(c AS STRING) || '")' || chr(10) || chr(10) ELSE '' END
  || '@part_' || CAST(d AS STRING) || '.wrap' || chr(10) || 'class P_' || CAST(k AS STRING) || '(P_' || CAST(c AS STRING) || '):' || chr(10)
  || '    def m_' || CAST(k AS STRING) || '(self, x: int) -> int:' || chr(10) || '        return x' || chr(10) || chr(10)
  || 'def f_' || CAST(k AS STRING) || '(x: int) -> int:' || chr(10) || CASE WHEN k % 9 = 0 THEN '    token = "auth"' || chr(10) ELSE '' END || '    return x' || chr(10) AS source
FROM (SELECT p_partkey AS k, (p_partkey * 7 + 1) % n + 1 AS a, (p_partkey * 3 + 2) % n + 1 AS b, CAST(floor(p_partkey / 2) AS BIGINT) AS c, (p_partkey * 11) % n + 1 AS d
  FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {part}) AS t)
"""
#: Customers as sources in groups of twelve, Python and TypeScript, each importing the one before it or the group's first.
GROUP_FILES = """
SELECT k AS file_ord, 'team' || CAST(g % 25 AS STRING) || '/unit' || CAST(g AS STRING) || CASE WHEN g % 3 = 0 THEN '/sub' || CAST(k % 2 AS STRING) ELSE '' END || '/cust_' || lpad(CAST(k AS STRING), 9, '0') || CASE WHEN k % 5 = 0 THEN '.ts' ELSE '.py' END AS path,
  CASE WHEN k % 12 = 0 THEN '' WHEN k % 5 = 0 THEN 'import x from "cust_' || t || '"' || chr(10) ELSE 'import cust_' || t || chr(10) END AS source, g, CASE WHEN k % 12 > 0 THEN m END AS target
FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 12) AS BIGINT) AS g, m, lpad(CAST(m AS STRING), 9, '0') AS t FROM (SELECT c_custkey, CASE WHEN CAST(floor(c_custkey / 12) AS BIGINT) % 2 = 0 THEN c_custkey - 1 ELSE c_custkey - c_custkey % 12 END AS m FROM {customer}) AS x) AS y
"""
#: Orders, parts and suppliers as modules; what an order holds and who supplies it as edges.
GRAPH_NODES = """
SELECT 'order/' || CAST(o_orderkey AS STRING) || '::__module__' AS node_id, 'order/' || CAST(o_orderkey AS STRING) AS file_path, o_orderkey AS node_ord FROM {orders}
UNION ALL SELECT 'part/' || CAST(p_partkey AS STRING) || '::__module__', 'part/' || CAST(p_partkey AS STRING), 1000000000 + p_partkey FROM {part}
UNION ALL SELECT 'supp/' || CAST(s_suppkey AS STRING) || '::__module__', 'supp/' || CAST(s_suppkey AS STRING), 2000000000 + s_suppkey FROM {supplier}
"""
GRAPH_EDGES = """
SELECT source_id, target_id, kind, weight, ord AS edge_ord FROM (
  SELECT 'order/' || CAST(l_orderkey AS STRING) || '::__module__' AS source_id, 'part/' || CAST(l_partkey AS STRING) || '::__module__' AS target_id,
    CASE l_returnflag WHEN 'N' THEN 'imports' WHEN 'A' THEN 'inherits' ELSE 'dynamic_import' END AS kind,
    CASE l_returnflag WHEN 'N' THEN CAST(1.0 AS DOUBLE) WHEN 'A' THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS weight, ((l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey % 1000000) * 4 + CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS ord FROM {lineitem}
  UNION ALL SELECT DISTINCT 'part/' || CAST(l_partkey AS STRING) || '::__module__', 'supp/' || CAST(l_suppkey AS STRING) || '::__module__', 'decorates', CAST(0.8 AS DOUBLE), 4000000000000000000 + l_partkey * 1000000 + l_suppkey FROM {lineitem}
) AS e
"""
#: One request for each order priority: its dearest order has changed.
REQUESTS = """
SELECT row_number() OVER (ORDER BY p) AS request_id, 'order/' || CAST(k AS STRING) AS changed
FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM {orders} JOIN (SELECT o_orderpriority AS q, max(o_totalprice) AS m FROM {orders} GROUP BY o_orderpriority) AS t ON o_orderpriority = q AND o_totalprice = m GROUP BY o_orderpriority) AS u
"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def duck_view(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
