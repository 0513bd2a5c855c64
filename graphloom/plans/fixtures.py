"""Graphs made of the driver's tables, as SQL that both Spark and DuckDB run ({table} stands for a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVENT_VERTICES = """
SELECT e.event_id AS vid, t.label AS label FROM {events} e JOIN (
  SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS label FROM (SELECT DISTINCT event_type FROM {events}) k) t ON e.event_type = t.event_type"""
_NEXT = "SELECT event_id AS src, lead(event_id, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, {label} AS elabel FROM {{events}}"
_ONE, _TWO = _NEXT.format(n=1, label=0), _NEXT.format(n=2, label=1)

#: Name: (vertices, edges). Edges may repeat and lie either way round.
GRAPHS = {
    "chain": (_EVENT_VERTICES, f"SELECT * FROM ({_ONE}) x WHERE dst IS NOT NULL"),
    "skip": (_EVENT_VERTICES, f"SELECT * FROM ({_ONE} UNION ALL {_TWO}) x WHERE dst IS NOT NULL"),
    "geo": (
        """SELECT CAST(r_regionkey AS BIGINT) AS vid, 0 AS label FROM {region} UNION ALL SELECT CAST(10 + n_nationkey AS BIGINT), 1 FROM {nation}
        UNION ALL SELECT 100 + 2 * s_suppkey, 2 FROM {supplier}
        UNION ALL SELECT 101 + 2 * c_custkey, 3 + t.r FROM {customer} c JOIN (
          SELECT c_mktsegment AS s, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS r FROM (SELECT DISTINCT c_mktsegment FROM {customer}) k) t ON c.c_mktsegment = t.s""",
        """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(10 + n_nationkey AS BIGINT) AS dst, 0 AS elabel FROM {nation}
        UNION ALL SELECT CAST(10 + s_nationkey AS BIGINT), 100 + 2 * s_suppkey, 1 FROM {supplier} UNION ALL SELECT CAST(10 + c_nationkey AS BIGINT), 101 + 2 * c_custkey, 2 FROM {customer}""",
    ),
    "trade": (
        """SELECT 2 * s_suppkey AS vid, CAST(n_regionkey AS INT) AS label FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        UNION ALL SELECT 2 * p_partkey + 1, 10 + t.r FROM {part} p JOIN (
          SELECT p_brand AS b, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS r FROM (SELECT DISTINCT p_brand FROM {part}) k) t ON p.p_brand = t.b""",
        """SELECT 2 * l_suppkey AS src, 2 * l_partkey + 1 AS dst, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS elabel
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    ),
    "dialog": (
        "SELECT conv_id * 1000 + turn AS vid, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS label FROM {conversations}",
        """SELECT a.conv_id * 1000 + a.turn AS src, b.conv_id * 1000 + b.turn AS dst, 0 AS elabel FROM {conversations} a JOIN {conversations} b
        ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    ),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem", "events", "conversations")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def graph(spark: SparkSession, sf_dir: str, name: str, parts: int = 0) -> tuple[DataFrame, DataFrame]:
    """vertices (with part_id = vid mod parts, if any) and edges of a graph."""
    v, e = (run_sql(spark, sf_dir, sql) for sql in GRAPHS[name])
    return (v.selectExpr("*", f"CAST(vid % {parts} AS INT) AS part_id") if parts else v), e


def graph_sql(name: str, parts: int = 1) -> str:
    """WITH clause that defines vertices, raw_edges, edges and arcs for DuckDB."""
    v, e = (sql.format(**{t: t for t in TABLES}) for sql in GRAPHS[name])
    return f"""WITH vertices AS (SELECT *, CAST(vid % {parts} AS INT) AS part_id FROM ({v})), raw_edges AS ({e}),
edges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, elabel FROM raw_edges WHERE src <> dst),
half AS (SELECT e.src, e.dst, e.elabel, a.label AS src_label, b.label AS dst_label FROM edges e JOIN vertices a ON e.src = a.vid JOIN vertices b ON e.dst = b.vid),
arcs AS (SELECT * FROM half UNION ALL SELECT dst, src, elabel, dst_label, src_label FROM half)
"""
