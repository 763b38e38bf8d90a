"""The SQL surface: statements handed to Spark as they are."""

from __future__ import annotations

from ..workspace import Workspace
from .registry import open_tables, query, same_sql

same_sql("q_agg", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n_rows,
       CAST(ROUND(SUM(l_quantity), 2) AS DOUBLE) AS sum_qty,
       CAST(ROUND(SUM(l_extendedprice), 2) AS DOUBLE) AS sum_price,
       CAST(ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue,
       COUNT(DISTINCT l_suppkey) AS n_suppliers,
       COUNT(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
       MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price
FROM lineitem
WHERE l_quantity IS NOT NULL AND l_linestatus != 'X'
GROUP BY 1, 2
HAVING COUNT(*) > 10
ORDER BY 3 DESC
""")

same_sql("q_count", "SELECT COUNT(*) AS n FROM lineitem")

same_sql("q_sum_by_group", """
SELECT o_custkey, CAST(ROUND(SUM(o_totalprice), 2) AS DOUBLE) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY total DESC
""")

same_sql("q_join_kinds", """
SELECT 'inner' AS kind, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS checksum
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT 'left', COUNT(*), CAST(SUM(c_custkey) AS BIGINT) FROM customer LEFT JOIN orders ON o_custkey = c_custkey
UNION ALL
SELECT 'right', COUNT(*), CAST(SUM(p_partkey) AS BIGINT)
FROM (SELECT * FROM lineitem WHERE l_quantity > 49) l RIGHT JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT 'full', COUNT(*), CAST(SUM(COALESCE(d.doc_id, 0)) AS BIGINT)
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1
UNION ALL
SELECT 'semi', COUNT(*), CAST(SUM(c_custkey) AS BIGINT) FROM customer SEMI JOIN orders ON c_custkey = o_custkey
UNION ALL
SELECT 'anti', COUNT(*), CAST(SUM(c_custkey) AS BIGINT) FROM customer ANTI JOIN orders ON c_custkey = o_custkey
UNION ALL
SELECT 'theta', COUNT(*), CAST(SUM(o_orderkey) AS BIGINT)
FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY
""")

same_sql("q_grouping_sets", """
SELECT 'rollup' AS kind, o_orderstatus AS a, o_orderpriority AS b, COUNT(*) AS n,
       CAST(GROUPING(o_orderstatus) + GROUPING(o_orderpriority) AS BIGINT) AS level
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
UNION ALL
SELECT 'cube', o_orderstatus, o_orderpriority, COUNT(*),
       CAST(GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS BIGINT)
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL
SELECT 'sets', o_orderstatus, o_orderpriority, COUNT(DISTINCT o_custkey),
       CAST(GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS BIGINT)
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""")

same_sql("q_windows", """
SELECT o_orderkey,
       CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, CAST(RANK() OVER w AS BIGINT) AS rnk,
       CAST(DENSE_RANK() OVER w AS BIGINT) AS drnk, CAST(NTILE(4) OVER w AS BIGINT) AS quartile,
       LAG(o_totalprice) OVER w AS prev_price, LEAD(o_totalprice) OVER w AS next_price,
       FIRST_VALUE(o_orderkey) OVER w AS first_order,
       CAST(ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS rolling,
       COUNT(*) OVER (PARTITION BY o_custkey) AS n_orders
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")

same_sql("q_setops", """
SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) u
UNION ALL
SELECT 'union_all', COUNT(*) FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders) u
UNION ALL
SELECT 'intersect', COUNT(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) i
UNION ALL
SELECT 'except', COUNT(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) e
UNION ALL
SELECT 'except_all', COUNT(*) FROM (SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier) e
UNION ALL
SELECT 'distinct', COUNT(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d
""")

same_sql("q_subqueries", """
WITH spend AS (
  SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey
)
SELECT c_custkey, c_mktsegment, CAST(ROUND(total, 2) AS DOUBLE) AS total,
       (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS n_filled
FROM customer c JOIN spend ON spend.o_custkey = c.c_custkey
WHERE total > (SELECT AVG(total) FROM spend)
  AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 1000)
""")

same_sql("q_functions", """
SELECT event_id,
       UPPER(event_type) AS upper_type, CAST(LENGTH(event_type) AS BIGINT) AS type_length, CONCAT(event_type, '-', CAST(user_id AS VARCHAR(20))) AS tag,
       REPLACE(event_type, 'i', 'I') AS replaced, SUBSTRING(event_type, 2, 3) AS middle, TRIM(CONCAT(' ', event_type, ' ')) AS trimmed,
       CAST(YEAR(ts) AS BIGINT) AS y, CAST(MONTH(ts) AS BIGINT) AS m, CAST(DAY(ts) AS BIGINT) AS d, CAST(HOUR(ts) AS BIGINT) AS h,
       ABS(value - 10.0) AS away, CAST(FLOOR(value) AS BIGINT) AS low, CAST(CEIL(value) AS BIGINT) AS high, ROUND(SQRT(ABS(value)), 6) AS root,
       CASE WHEN value > 20 THEN 'big' WHEN value > 5 THEN 'mid' ELSE 'small' END AS size_class,
       COALESCE(NULLIF(event_type, 'error'), 'none') AS no_error,
       event_type LIKE '%ck' AS ends_ck, value BETWEEN 5 AND 20 AS in_range, user_id % 7 AS bucket
FROM events
""")

same_sql("q_topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 50 OFFSET 10
""")


@query("q_ctas", """
SELECT row_number() OVER (ORDER BY o_custkey) AS _rid, o_custkey, n_orders
FROM (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey)
""")
def q_ctas(spark, sf_dir):
    """CREATE TABLE AS: the result becomes a table of the catalog that further SQL can read."""
    from ..sources.row_ids import number_rows_by

    open_tables(spark, sf_dir)
    workspace = Workspace(spark)
    counts = workspace.sql("SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey")
    workspace.register("orders_per_customer", number_rows_by(counts, ["o_custkey"]), "sql")
    return workspace.sql("SELECT _rid, o_custkey, n_orders FROM orders_per_customer;")
