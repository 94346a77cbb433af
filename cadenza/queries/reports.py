"""Pivots, rules, and the flagship load report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.compare import side_by_side
from cadenza.plans.findings import Rule, apply_rules
from cadenza.queries.registry import query, table


@query("""
SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS "F", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS "O", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS "P"
FROM orders GROUP BY o_orderpriority
""")
def pivot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a priority, a column a status."""
    return side_by_side(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.round(F.avg("o_totalprice"), 4), ["F", "O", "P"])


@query("""
WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS mean, max(value) AS top, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT user_id, 1 AS ord, CASE WHEN errors > 0.3 * n THEN 'critical' ELSE 'warning' END AS kind, CAST(errors AS VARCHAR) || ' errors in ' || CAST(n AS VARCHAR) || ' events' AS title FROM s WHERE errors > 0.2 * n
UNION ALL SELECT user_id, 2, CASE WHEN top > 10 * mean THEN 'warning' ELSE 'info' END, 'A peak far above the mean' FROM s WHERE top > 6 * mean
UNION ALL SELECT user_id, 3, 'good', 'Nothing stood out' FROM s WHERE NOT (errors > 0.2 * n) AND NOT (top > 6 * mean)
""")
def findings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that speak only where the numbers bear them out."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
    many, high = F.col("errors") > 0.2 * F.col("n"), F.col("top") > 6 * F.col("mean")
    rules = [
        Rule(many, F.when(F.col("errors") > 0.3 * F.col("n"), "critical").otherwise("warning"), F.format_string("%d errors in %d events", "errors", "n")),
        Rule(high, F.when(F.col("top") > 10 * F.col("mean"), "warning").otherwise("info"), F.lit("A peak far above the mean")),
        Rule(~many & ~high, F.lit("good"), F.lit("Nothing stood out")),
    ]
    return apply_rules(s, ("user_id",), rules).select("user_id", "ord", "kind", "title")
