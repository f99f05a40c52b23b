"""The query catalogue: every operator as a query over the driver's tables, with SQL for the same rows.

Entries of ``CYPHER`` are (graph view, openCypher, SQL); the others are functions of (spark, sf_dir).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import canonical_name
from .functions.vectors import cosine
from .model import MapGraph
from .operators import algorithms, knowledge, vector_search
from .operators import link_prediction as link_model
from .plans import compiler
from .session import PROCEDURES, GraphSession
from .sources import files, views
from .sources.views import table
from .streaming import triangles as stream

_CO = "(SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)"
_EV = "(SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, event_type AS type FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL)"
_EVC = f"(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_EV} WHERE src <> dst)"
_CUST = "SELECT c_custkey AS id, c_name AS name FROM customer"
_TRI = "SELECT x.a AS a, x.b AS b, y.b AS c FROM {e} x JOIN {e} y ON x.b = y.a JOIN {e} z ON z.a = x.a AND z.b = y.b"


def _where(cypher: str, sql: str) -> tuple[str, str, str]:
    return ("commerce", f"MATCH (c:Customer) WHERE {cypher} RETURN c.c_custkey AS id, c.c_name AS name", f"{_CUST} WHERE {sql}")


CYPHER: dict[str, tuple[str, str, str]] = {
    "all_node_scan": ("commerce", "MATCH (n) RETURN labels(n)[0] AS label, id(n) AS id", "SELECT 'Customer' AS label, c_custkey AS id FROM customer UNION ALL SELECT 'Order', o_orderkey FROM orders UNION ALL SELECT 'Part', p_partkey FROM part UNION ALL SELECT 'Supplier', s_suppkey FROM supplier UNION ALL SELECT 'Nation', n_nationkey FROM nation UNION ALL SELECT 'Region', r_regionkey FROM region"),
    "node_scan_by_label": ("commerce", "MATCH (c:Customer) RETURN c.c_custkey AS custkey, c.c_name AS name", "SELECT c_custkey AS custkey, c_name AS name FROM customer"),
    "node_by_id_seek": ("commerce", "MATCH (p:Part) WHERE id(p) = 42 RETURN p.p_partkey AS id, p.p_name AS name", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 42"),
    "multi_label_scan": ("commerce", "MATCH (n:Customer:Part) RETURN id(n) AS id UNION ALL MATCH (n:Nation) RETURN id(n) AS id", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation"),
    "minimum_slice": ("commerce", "MATCH (c:Customer) WHERE c.c_mktsegment = 'FURNITURE' RETURN c.c_custkey AS custkey, c.c_name AS name", "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_mktsegment = 'FURNITURE'"),
    "filter_eq": _where("c.c_nationkey = 7", "c_nationkey = 7"),
    "filter_ne": _where("c.c_mktsegment <> 'FURNITURE'", "c_mktsegment <> 'FURNITURE'"),
    "filter_lt": _where("c.c_acctbal < 0", "c_acctbal < 0"),
    "filter_gt": _where("c.c_acctbal > 5000.5", "c_acctbal > 5000.5"),
    "filter_le": _where("c.c_nationkey <= 5", "c_nationkey <= 5"),
    "filter_ge": _where("c.c_nationkey >= 20", "c_nationkey >= 20"),
    "filter_chained": _where("3 < c.c_nationkey <= 9", "c_nationkey > 3 AND c_nationkey <= 9"),
    "filter_string_order": _where("c.c_mktsegment < 'C'", "c_mktsegment < 'C'"),
    "filter_and": _where("c.c_nationkey = 7 AND c.c_acctbal > 0", "c_nationkey = 7 AND c_acctbal > 0"),
    "filter_or": _where("c.c_nationkey = 7 OR c.c_acctbal < 0", "c_nationkey = 7 OR c_acctbal < 0"),
    "filter_xor": _where("c.c_nationkey = 7 XOR c.c_acctbal < 0", "(c_nationkey = 7) <> (c_acctbal < 0)"),
    "filter_not": _where("NOT (c.c_nationkey < 20)", "NOT (c_nationkey < 20)"),
    "filter_is_null": _where("c.missing IS NULL AND c.c_name IS NOT NULL", "c_name IS NOT NULL"),
    "filter_is_not_null": _where("c.c_mktsegment IS NOT NULL", "c_mktsegment IS NOT NULL"),
    "filter_in_list": _where("c.c_nationkey IN [1, 3, 5]", "c_nationkey IN (1, 3, 5)"),
    "filter_starts_with": _where("c.c_mktsegment STARTS WITH 'B'", "starts_with(c_mktsegment, 'B')"),
    "filter_ends_with": _where("c.c_name ENDS WITH '7'", "c_name LIKE '%7'"),
    "filter_contains": _where("c.c_name CONTAINS '12'", "contains(c_name, '12')"),
    "filter_regex": _where("c.c_name =~ '.*0[13]'", "regexp_full_match(c_name, '.*0[13]')"),
    "filter_id_function": _where("id(c) <> 3 AND id(c) >= 0", "c_custkey <> 3 AND c_custkey >= 0"),
    "inline_map": ("commerce", "MATCH (c:Customer {c_nationkey: 7, c_mktsegment: 'FURNITURE'}) RETURN c.c_custkey AS id", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'FURNITURE'"),
    "var_compare": ("commerce", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(d:Customer) WHERE c <> d RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer c JOIN customer d ON c.c_nationkey = d.c_nationkey AND c.c_custkey <> d.c_custkey JOIN nation ON n_nationkey = c.c_nationkey GROUP BY n_name"),
    "rel_type_directed_right": ("commerce", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey"),
    "rel_type_directed_left": ("commerce", "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.c_nationkey = 3 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3"),
    "rel_type_undirected": ("commerce", "MATCH (a)-[:IN_REGION]-(b) RETURN labels(a)[0] AS la, id(a) AS a, id(b) AS b", "SELECT 'Nation' AS la, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION ALL SELECT 'Region', n_regionkey, n_nationkey FROM nation"),
    "rel_all_directed": ("commerce", "MATCH (n:Nation)-[r]->(m) RETURN type(r) AS type, id(n) AS a, id(m) AS b", "SELECT 'IN_REGION' AS type, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation"),
    "rel_all_undirected": ("commerce", "MATCH (n:Nation)-[r]-(m) RETURN type(r) AS type, count(*) AS n", "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey)"),
    "rel_multiple_types": ("commerce", "MATCH (x)-[:IN_NATION|IN_REGION]->(y) RETURN labels(x)[0] AS la, count(*) AS n", "SELECT 'Customer' AS la, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation"),
    "expand_1hop": ("commerce", "MATCH (o:Order {o_orderstatus: 'F'})-[r:CONTAINS]->(p:Part) WHERE p.p_size < 5 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.l_quantity AS qty", "SELECT o_orderkey AS o, p_partkey AS p, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND p_size < 5"),
    "expand_2hop": ("commerce", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE c.c_mktsegment = 'FURNITURE' AND p.p_size > 25 RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'FURNITURE' AND p_size > 25 GROUP BY p_brand"),
    "expand_3hop": ("commerce", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(o) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name"),
    "expand_remote_unique": ("commerce", "MATCH (a:Nation)-[r1:IN_REGION]->(r:Region)<-[r2:IN_REGION]-(b:Nation) RETURN a.n_name AS a, b.n_name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey"),
    "cartesian_product": ("commerce", "MATCH (r:Region), (n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation"),
    "cartesian_equi": ("commerce", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "projection_alias": ("commerce", "MATCH (p:Part) RETURN p.p_name AS title, p.p_size AS size", "SELECT p_name AS title, p_size AS size FROM part"),
    "return_star": ("commerce", "MATCH (n:Nation) WITH n.n_nationkey AS k, n.n_name AS name RETURN *", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "arithmetic": ("commerce", "MATCH (p:Part) RETURN p.p_partkey AS id, (p.p_size + 3) * 2 - 1 AS a, p.p_size % 7 AS m, -p.p_size AS neg, 2 ^ 3 AS pow, 0x1F AS hex, p.p_size / 4.0 AS q", "SELECT p_partkey AS id, (p_size + 3) * 2 - 1 AS a, p_size % 7 AS m, -p_size AS neg, CAST(8.0 AS DOUBLE) AS pow, 31 AS hex, CAST(p_size AS DOUBLE) / 4 AS q FROM part"),
    "case_when": ("commerce", "MATCH (p:Part) RETURN p.p_partkey AS id, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p.p_size WHEN 1 THEN 'one' ELSE 'more' END AS one", "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS one FROM part"),
    "string_functions": ("commerce", "MATCH (n:Nation) RETURN toLower(n.n_name) AS low, toUpper(n.n_name) AS up, substring(n.n_name, 1, 3) AS sub, left(n.n_name, 2) AS l, right(n.n_name, 2) AS r, replace(n.n_name, 'A', '_') AS rep, size(n.n_name) AS len, reverse(n.n_name) AS rev, trim('  x ') AS t", "SELECT lower(n_name) AS low, upper(n_name) AS up, substring(n_name, 2, 3) AS sub, left(n_name, 2) AS l, right(n_name, 2) AS r, replace(n_name, 'A', '_') AS rep, length(n_name) AS len, reverse(n_name) AS rev, 'x' AS t FROM nation"),
    "math_functions": ("commerce", "MATCH (p:Part) RETURN p.p_partkey AS id, abs(p.p_size - 20) AS a, toInteger(floor(p.p_retailprice)) AS f, toInteger(ceil(p.p_retailprice)) AS c, sign(p.p_size - 20) AS s, coalesce(p.missing, 'none') AS co, toString(p.p_size) AS t", "SELECT p_partkey AS id, abs(p_size - 20) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(sign(p_size - 20) AS DOUBLE) AS s, 'none' AS co, CAST(p_size AS VARCHAR) AS t FROM part"),
    "list_operations": ("commerce", "MATCH (r:Region) WITH r.r_regionkey AS k, [x IN range(1, 6) WHERE x % 2 = 0 | x * 10] AS xs RETURN k, xs[0] AS first, xs[-1] AS last, size(xs) AS n, size(xs[1..]) AS rest, all(x IN xs WHERE x > 10) AS every, any(x IN xs WHERE x > 50) AS some, none(x IN xs WHERE x > 70) AS no, single(x IN xs WHERE x = 40) AS one", "SELECT r_regionkey AS k, 20 AS first, 60 AS last, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS rest, TRUE AS every, TRUE AS some, TRUE AS no, TRUE AS one FROM region"),
    "distinct_return": ("commerce", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS seg", "SELECT DISTINCT c_mktsegment AS seg FROM customer"),
    "order_by_asc": ("commerce", "MATCH (c:Customer) RETURN c.c_custkey AS id ORDER BY c.c_acctbal, c.c_custkey LIMIT 10", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10"),
    "order_by_desc": ("commerce", "MATCH (c:Customer) RETURN c.c_custkey AS id ORDER BY c.c_acctbal DESC, id LIMIT 10", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "order_by_multi": ("commerce", "MATCH (p:Part) RETURN p.p_partkey AS id, p.p_size AS size ORDER BY p.p_size DESC, p.p_brand ASC, p.p_partkey DESC LIMIT 25", "SELECT p_partkey AS id, p_size AS size FROM part ORDER BY p_size DESC, p_brand, p_partkey DESC LIMIT 25"),
    "skip": ("commerce", "MATCH (n:Nation) RETURN n.n_nationkey AS k ORDER BY k SKIP 20", "SELECT n_nationkey AS k FROM nation ORDER BY k OFFSET 20"),
    "limit": ("commerce", "MATCH (n:Nation) RETURN n.n_nationkey AS k ORDER BY k LIMIT 5", "SELECT n_nationkey AS k FROM nation ORDER BY k LIMIT 5"),
    "top_k": ("commerce", "MATCH (o:Order) RETURN o.o_orderkey AS o, o.o_totalprice AS price ORDER BY price DESC, o SKIP 3 LIMIT 7", "SELECT o_orderkey AS o, o_totalprice AS price FROM orders ORDER BY price DESC, o LIMIT 7 OFFSET 3"),
    "avg_global": ("commerce", "MATCH (p:Part) WHERE p.p_size < 10 RETURN avg(p.p_size) AS a", "SELECT avg(p_size) AS a FROM part WHERE p_size < 10"),
    "avg_grouped": ("commerce", "MATCH (p:Part) RETURN p.p_brand AS brand, avg(p.p_size) AS a", "SELECT p_brand AS brand, avg(p_size) AS a FROM part GROUP BY p_brand"),
    "count_star": ("commerce", "MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders"),
    "sum_min_max": ("commerce", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, sum(r.l_quantity) AS total, min(r.l_quantity) AS low, max(r.l_quantity) AS high", "SELECT p_brand AS brand, sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY p_brand"),
    "count_distinct": ("commerce", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, count(DISTINCT c) AS n", "SELECT c_mktsegment AS seg, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "collect_size": ("commerce", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS region, collect(n.n_name) AS names RETURN region, size(names) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "aggregate_expression": ("commerce", "MATCH (p:Part) RETURN p.p_brand AS brand, count(*) * 2 + max(p.p_size) AS x", "SELECT p_brand AS brand, count(*) * 2 + max(p_size) AS x FROM part GROUP BY p_brand"),
    "union": ("commerce", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("commerce", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "intersect": ("commerce", "MATCH (c:Customer) RETURN c.c_nationkey AS k INTERSECT MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "with_chain": ("commerce", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.o_totalprice) AS total WHERE n > 12 MATCH (c)-[:IN_NATION]->(k:Nation) RETURN k.n_name AS nation, c.c_custkey AS c, n", "SELECT n_name AS nation, c, n FROM (SELECT o_custkey AS c, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey HAVING count(*) > 12) JOIN customer ON c_custkey = c JOIN nation ON n_nationkey = c_nationkey"),
    "optional_match": ("commerce", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'P' RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey"),
    "exists_semi": ("commerce", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "not_exists_anti": ("commerce", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "unwind": ("commerce", "UNWIND [3, 1, 2] AS x MATCH (r:Region) WHERE r.r_regionkey = x RETURN x, r.r_name AS name", "SELECT r_regionkey AS x, r_name AS name FROM region WHERE r_regionkey IN (1, 2, 3)"),
    "var_length_1_3": ("commerce", "MATCH (c:Customer)-[:PLACED|IN_NATION|IN_REGION*1..3]->(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Order' AS label, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'Nation', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'Region', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "named_path": ("commerce", "MATCH p = (c:Customer)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS c, length(p) AS n, r.r_name AS r", "SELECT c_custkey AS c, CAST(2 AS BIGINT) AS n, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "aggregate_distinct": ("commerce", "MATCH (p:Part) RETURN p.p_brand AS brand, avg(DISTINCT p.p_size) AS a, stdev(DISTINCT p.p_size) AS s, sum(DISTINCT p.p_size) AS t", "SELECT p_brand AS brand, avg(DISTINCT p_size) AS a, stddev_samp(DISTINCT p_size) AS s, CAST(sum(DISTINCT p_size) AS BIGINT) AS t FROM part GROUP BY p_brand"),
    "stdev_percentile": ("commerce", "MATCH (o:Order) RETURN o.o_orderpriority AS priority, round(stdev(o.o_totalprice), 4) AS s, round(stDevP(o.o_totalprice), 4) AS sp, round(percentileCont(o.o_totalprice, 0.3), 4) AS p", "SELECT o_orderpriority AS priority, round(stddev_samp(o_totalprice), 4) AS s, round(stddev_pop(o_totalprice), 4) AS sp, round(quantile_cont(o_totalprice, 0.3), 4) AS p FROM orders GROUP BY o_orderpriority"),
    "optional_after_with": ("commerce", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n OPTIONAL MATCH (c)-[:IN_NATION]->(k:Nation) WHERE n > 10 RETURN c.c_custkey AS c, n, k.n_name AS nation", "SELECT c_custkey AS c, n, CASE WHEN n > 10 THEN n_name END AS nation FROM (SELECT c_custkey, c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey"),
    "optional_repeated_rows": ("commerce", "MATCH (o:Order)-[:CONTAINS]->(p:Part) WITH p.p_brand AS brand, o AS o WHERE o.o_orderkey < 400 OPTIONAL MATCH (c:Customer)-[:PLACED]->(o) WHERE c.c_acctbal > 0 RETURN brand, o.o_orderkey AS o, c.c_custkey AS c", "SELECT p_brand AS brand, o_orderkey AS o, c_custkey AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderkey < 400"),
    "var_length_open": ("commerce", "MATCH (c:Customer)-[:PLACED|CONTAINS|SUPPLIED_BY|IN_NATION|IN_REGION*]->(r:Region) WHERE c.c_custkey = 7 RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM (SELECT n_regionkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7 UNION ALL SELECT n_regionkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) ON pk = l_partkey JOIN part ON p_partkey = pk JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey WHERE o_custkey = 7) JOIN region ON r_regionkey = k GROUP BY r_name"),
    "exists_or": ("commerce", "MATCH (c:Customer) WHERE c.c_acctbal < 0 OR EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "exists_returned": ("commerce", "MATCH (c:Customer) RETURN c.c_custkey AS c, CASE WHEN (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) THEN 'some' ELSE 'none' END AS pending", "SELECT c_custkey AS c, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'some' ELSE 'none' END AS pending FROM customer"),
    "pattern_comprehension": ("commerce", "MATCH (n:Nation) WITH n, [(n)<-[:IN_NATION]-(c:Customer) WHERE c.c_acctbal < 0 | c.c_custkey] AS xs RETURN n.n_name AS nation, size(xs) AS n, any(x IN xs WHERE x > 50) AS late", "SELECT n_name AS nation, count(c_custkey) AS n, coalesce(bool_or(c_custkey > 50), false) AS late FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_name"),
    "except": ("commerce", "MATCH (n:Nation) RETURN n.n_nationkey AS k EXCEPT MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier"),
    "except_all": ("commerce", "MATCH (c:Customer) RETURN c.c_nationkey AS k EXCEPT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "return_node": ("commerce", "MATCH (n:Nation) WITH n AS m WHERE m.n_nationkey < 9 WITH collect(m) AS ms UNWIND ms AS x RETURN x.n_nationkey AS k, x.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 9"),
    "map_value": ("commerce", "MATCH (n:Nation) WITH {k: n.n_nationkey, name: n.n_name} AS m WHERE m.k < 12 RETURN m.name AS name, m.k + 1 AS next", "SELECT n_name AS name, n_nationkey + 1 AS next FROM nation WHERE n_nationkey < 12"),
    "order_mixed_nulls": ("commerce", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 WITH n, max(s.s_acctbal) AS top RETURN n.n_nationkey AS k ORDER BY top DESC, k LIMIT 12", "SELECT n_nationkey AS k FROM nation LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS top FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey ORDER BY top DESC NULLS FIRST, k LIMIT 12"),
    "unwind_stored_list": ("commerce", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.n_name) AS names UNWIND names AS name RETURN r.r_name AS region, name", "SELECT r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "call_procedure": ("copurchase", "CALL algo.triangleCount() YIELD n_triangles AS n RETURN n", f"SELECT count(*) AS n FROM ({_TRI.format(e=_CO)})"),
}


def _people(spark: SparkSession, sf_dir: str) -> MapGraph:
    """A schema-less graph over nations and regions, whose properties are strings."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    props = lambda label, **c: F.create_map(F.lit("label"), F.lit(label), *[x for k, v in c.items() for x in (F.lit(k), F.col(v).cast("string"))])
    nation = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.lit("Nation").alias("label"), props("Nation", name="n_name", key="n_nationkey").alias("props"), (F.col("n_nationkey") % 2).cast("int").alias("pid"))
    region = r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit("Region").alias("label"), props("Region", name="r_name", key="r_regionkey").alias("props"), (F.col("r_regionkey") % 2).cast("int").alias("pid"))
    edges = n.select(F.concat(F.lit("e"), F.col("n_nationkey")).alias("eid"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"), F.lit("IN").alias("type"), F.create_map(F.lit("type"), F.lit("IN")).alias("props"))
    return MapGraph(nation.unionByName(region), edges)


def _update(update: str, read: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compiler.run(spark, compiler.run(spark, _people(spark, sf_dir), update).graph, read).rows

    return run


_ALL = "MATCH (n) RETURN id(n) AS id, n.name AS name"
_NODES = "SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region"

UPDATES: dict[str, tuple[str, str, str]] = {
    "create_nodes": ("CREATE (a:City {id: 'c1', name: 'Here'}), (b:City {id: 'c2', name: 'There'})", _ALL, f"{_NODES} UNION ALL SELECT 'c1', 'Here' UNION ALL SELECT 'c2', 'There'"),
    "create_edges": ("MATCH (n:Nation)-[:IN]->(r:Region) CREATE (r)-[:HOLDS]->(n)", "MATCH (r)-[:HOLDS]->(n) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "create_then_match": ("MATCH (n:Nation)-[:IN]->(r:Region) CREATE (r)-[h:HOLDS]->(n), (r)-[g:HOLDS]->(n) WITH h AS h WHERE h.type = 'HOLDS' DELETE h", "MATCH (r)-[:HOLDS]->(n) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "merge_relationship": ("MATCH (n:Nation)-[:IN]->(r:Region) MERGE (n)-[:IN]->(r)", "MATCH (n)-[:IN]->(r) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "merge_pattern": ("MATCH (n:Nation) WHERE n.key < 3 MERGE (n)-[:HAS]->(f:Flag {id: n.name, name: n.name})", "MATCH (n)-[:HAS]->(f:Flag) RETURN id(n) AS id, f.name AS name", "SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 3"),
    "delete_plain": ("CREATE (a:City {id: 'c1', name: 'Here'}), (b:City {id: 'c2', name: 'There'}) WITH a AS a DELETE a", _ALL, f"{_NODES} UNION ALL SELECT 'c2', 'There'"),
    "merge": ("MERGE (a:City {id: 'c1', name: 'Here'}) ON CREATE SET a.made = 'yes' ON MATCH SET a.made = 'no'", "MATCH (n:City) RETURN n.name AS name, n.made AS made", "SELECT 'Here' AS name, 'yes' AS made"),
    "set_props": ("MATCH (n:Nation) WHERE n.key < 5 SET n.name = 'changed', n.extra = 7", "MATCH (n:Nation) RETURN id(n) AS id, n.name AS name, n.extra AS extra", "SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'changed' ELSE n_name END AS name, CASE WHEN n_nationkey < 5 THEN '7' END AS extra FROM nation"),
    "delete": ("MATCH (n:Nation) WHERE n.key >= 10 DETACH DELETE n", "MATCH (n:Nation)-[:IN]->(r) RETURN id(n) AS id, r.name AS r", "SELECT 'n' || n_nationkey AS id, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 10"),
    "remove": ("MATCH (n:Nation) WHERE n.key = 3 REMOVE n.name", "MATCH (n:Nation) WHERE n.name IS NULL RETURN id(n) AS id", "SELECT 'n3' AS id"),
    "partition_property": ("MATCH (n:Nation) SET n.seen = 'x'", "MATCH (n:Nation) WHERE n.partitionID = '1' RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 1"),
}


# --------------------------------------------------------------------------- algorithms, sources, streams
def _event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_edges(spark, sf_dir)


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of vec_id 0, or of the least vec_id of a table without it; of an empty table one zero."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding").orderBy("vec_id").limit(1).collect()
    return list(rows[0].embedding) if rows else [0.0]


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it is removed when Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before Python did
        pass


def pagerank_10(spark, sf_dir):
    return algorithms.pagerank(_event_graph(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


def _pagerank_sql(rounds: int) -> str:
    e = f"e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_EV}), o AS (SELECT src, count(*) AS c FROM e GROUP BY src), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"
    for i in range(rounds):
        e += f", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(s, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / n) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst AS id, sum(rank / c) AS s FROM e JOIN o USING (src) JOIN r{i} ON r{i}.id = e.src GROUP BY e.dst) USING (id))"
    return f"WITH {e} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


def partition_stats(spark, sf_dir):
    e = _event_graph(spark, sf_dir)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return algorithms.partition_statistics(e, algorithms.hash_partition(ids, 4)).withColumn("cut_ratio", F.round("cut_ratio", 9))


def knn_l2(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10).select("vec_id", F.round("distance", 5).alias("distance"))


def cosine_topk(spark, sf_dir):
    return vector_search.most_similar(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10).select("vec_id", F.round("similarity", 5).alias("similarity"))


def beam_search(spark, sf_dir):
    edges = lambda ids: views.copurchase_around(spark, sf_dir, ids).select(F.concat_ws("-", "src", "dst").alias("eid"), "src", "dst", F.lit("WITH").alias("type"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = vector_search.beam_search(vectors, edges, _first_vector(spark, sf_dir))
    return out.select(F.concat_ws(",", F.transform("path_nodes", lambda x: x.cast("string"))).alias("path"), F.round("score", 6).alias("score"))


def cosine_to_first(spark, sf_dir):
    query = F.array(*[F.lit(x) for x in _first_vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), query), 5).alias("similarity"))


def _stream(run: Callable[[SparkSession, str, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Writes the events as edge records to a folder, as a stream's source, and lets the stream read all of it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _shared_folder(spark, "stream")
        e = views.event_edges(spark, sf_dir)
        end = lambda c: F.struct(F.col(c).cast("string").alias("id"), F.create_map().cast("map<string,string>").alias("properties"))
        record = F.to_json(F.struct(end("src").alias("source"), end("dst").alias("destination"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("type"), F.col("type")).alias("properties")))
        e.select(record.alias("value")).repartition(4).write.text(f"{root}/in")
        return run(spark, root, stream.edge_stream(spark, f"{root}/in", files_per_trigger=2))

    return query


def _stream_triangles(spark, root, edges):
    s = stream.TriangleStream(spark, f"{root}/state")
    s.start(edges, f"{root}/checkpoint", availableNow=True).awaitTermination()
    return s.total()


def _stream_recount(spark, root, edges):
    s = stream.TriangleStream(spark, f"{root}/state")
    s.start(edges, f"{root}/checkpoint", availableNow=True).awaitTermination()
    return s.recount()


def stream_windows(spark, sf_dir):
    """Events by type and hour, from a stream of files with a watermark."""
    root = _shared_folder(spark, "windows")
    views.event_edges(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "type").repartition(3).write.parquet(f"{root}/in")
    events = spark.readStream.schema("ts timestamp, type string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    name = "windows_" + root[-32:]
    q = stream.windowed_edges(events, late="3650 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "type", "n_edges")


def _stream_dedup(spark, root, edges):
    q = stream.deduplicated(edges).select("src", "dst", "eid", "type").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("type").agg(F.count("*").alias("n"))


def _stream_degree(spark, root, edges):
    name = "degrees_" + root[-32:]
    q = stream.running_degrees(edges).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def edge_list_roundtrip(spark, sf_dir):
    path = _shared_folder(spark, "edges")
    files.write_edge_list(_event_graph(spark, sf_dir), path)
    return files.edge_list(spark, path)


def kg_canonicalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), canonical_name(F.concat_ws(" / ", "p_name", "p_type", F.lit("-X-"))).alias("name"))


def kg_build(spark, sf_dir):
    g = knowledge.build(knowledge.extract(knowledge.sentences(table(spark, sf_dir, "benchmark"), key="item_id")))
    return compiler.run(spark, g, "MATCH (a)-[r]->(b) RETURN type(r) AS type, count(*) AS n").rows


def text_chunks(spark, sf_dir):
    return knowledge.chunks(table(spark, sf_dir, "documents"), 500).select("doc_id", "chunk", "start", F.length("text").alias("n"))


def link_prediction(spark, sf_dir):
    s = algorithms.neighbour_scores(_event_graph(spark, sf_dir))
    return s.select("a", "b", "common", F.round("jaccard", 8).alias("jaccard"), F.round("adamic_adar", 6).alias("adamic_adar"))


def label_partition(spark, sf_dir):
    return algorithms.label_partition(_event_graph(spark, sf_dir), 4)


def link_prediction_trained(spark, sf_dir):
    """Probabilities of unlinked pairs by a model trained on the same graph, with vectors of the vertices aggregated over sampled neighbours."""
    e = _event_graph(spark, sf_dir).select("src", "dst")
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    return link_model.train(e, vectors=vectors).predict(e, vectors).select("a", "b", F.round("probability", 6).alias("probability"))


def rank_distribution(spark, sf_dir):
    return algorithms.rank_distribution(algorithms.pagerank(_event_graph(spark, sf_dir)), 3)


def graph_roundtrip(spark, sf_dir):
    path = _shared_folder(spark, "graph")
    files.write_graph(_people(spark, sf_dir), path)
    return compiler.run(spark, files.read_graph(spark, path), "MATCH (n:Nation)-[r:IN]->(m) RETURN id(n) AS id, n.name AS n, m.name AS m, type(r) AS type").rows


def property_graph_roundtrip(spark, sf_dir):
    """Orders as edge records of JSON lines, read back as a property graph."""
    path = _shared_folder(spark, "records")
    end = lambda kind, c: F.struct(F.concat(F.lit(kind), F.col(c)).alias("id"), F.create_map(F.lit("label"), F.lit(kind), F.lit("key"), F.col(c).cast("string")).alias("properties"))
    props = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("type"), F.lit("PLACED"), F.lit("status"), F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders")
    o.select(F.to_json(F.struct(end("Customer", "o_custkey").alias("source"), end("Order", "o_orderkey").alias("destination"), props.alias("properties"))).alias("value")).write.text(path)
    return compiler.run(spark, files.property_graph_json(spark, path), "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE r.status = 'P' RETURN c.key AS c, o.key AS o").rows


def text_attributes_roundtrip(spark, sf_dir):
    path = _shared_folder(spark, "attributes")
    p = table(spark, sf_dir, "part")
    p.select(F.concat_ws(" ", "p_partkey", "p_size", (F.col("p_size") * 300).cast("string")).alias("value")).write.text(path)
    f = files.text_attributes(spark, path, "int32")
    return f.select(F.col("vertex_id").alias("id"), F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


def rdf_roundtrip(spark, sf_dir):
    path = _shared_folder(spark, "rdf")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n.select(F.concat(F.col("n_name"), F.lit("\tin "), F.col("r_name")).alias("value")).write.text(path)
    edges, nodes, predicates = files.rdf_triples(spark, path)
    names = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(c + "_name"))
    found = edges.join(names("src"), "src").join(names("dst"), "dst").join(predicates.withColumnRenamed("id", "predicate"), "predicate")
    return found.select(F.col("src_name").alias("s"), F.col("name").alias("p"), F.col("dst_name").alias("o"))


def json_attributes_roundtrip(spark, sf_dir):
    path = _shared_folder(spark, "json")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex_id"), F.struct("p_size", "p_brand").alias("features")).write.json(path)
    a = files.json_attributes(spark, path, "vertex_id long, features struct<p_size:int,p_brand:string>")
    return a.select(F.col("vertex_id").alias("id"), F.col("features.p_size").alias("size"), F.col("features.p_brand").alias("brand"))


def xml_attributes_roundtrip(spark, sf_dir):
    path = _shared_folder(spark, "xml")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex_id"), "p_size", "p_brand").write.format("xml").option("rootTag", "parts").option("rowTag", "part").save(path)
    return files.xml_attributes(spark, path, "part", "vertex_id long, p_size int, p_brand string").select(F.col("vertex_id").alias("id"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


def rdf_xml_roundtrip(spark, sf_dir):
    """Orders as articles whose authors are their parts, in the order of the parts' numbers as text."""
    path = _shared_folder(spark, "articles")
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("title")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("author"))
    o.select("author", "title").write.format("xml").option("rootTag", "articles").option("rowTag", "article").save(path)
    edges, _ = files.rdf_xml(spark, path)
    return edges.select("title", F.col("src_name").alias("a"), F.col("dst_name").alias("b"))


def parameters(spark, sf_dir):
    text = "MATCH (c:Customer) WHERE c.c_mktsegment = $segment AND c.c_nationkey IN [$first, $second] RETURN c.c_custkey AS id"
    return compiler.run(spark, views.commerce(spark, sf_dir), text, {"segment": "BUILDING", "first": 3, "second": 9}).rows


def catalog_list(spark, sf_dir):
    s = GraphSession(spark)
    s.add_pairs("events", _event_graph(spark, sf_dir).select("src", "dst"))
    s.add("people", _people(spark, sf_dir))
    s.add("gone", _people(spark, sf_dir))
    s.catalog.remove("gone")
    return s.run_command("lst").select("id", "name", "status", "is_directed")


def citation_roundtrip(spark, sf_dir):
    """Orders as papers that cite the parts they hold."""
    path = _shared_folder(spark, "citations")
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("references"))
    o.write.json(path)
    return files.citation_json(spark, path)[0]


def federated_mean(spark, sf_dir):
    """Weighted mean of each client's weights: sum(n * w) / sum(n)."""
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "w"))
    client = v.groupBy("label", "i").agg(F.count("*").alias("n"), F.avg(F.col("w").cast("double")).alias("w"))
    return client.groupBy("i").agg(F.round(F.sum(F.col("n") * F.col("w")) / F.sum("n"), 8).alias("weight"))


def _canonical(sql: str) -> str:
    return f"regexp_replace(regexp_replace(lower({sql}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_DEG = f"SELECT src AS id, count(DISTINCT dst) AS degree FROM {_EV} GROUP BY src"
_IN = f"SELECT dst AS id, count(DISTINCT src) AS degree FROM {_EV} GROUP BY dst"
_IDS = f"(SELECT src AS id FROM {_EV} UNION SELECT dst FROM {_EV})"
_SYM = f"(SELECT a, b FROM {_EVC} UNION ALL SELECT b, a FROM {_EVC})"

FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "vertex_count": (lambda s, d: algorithms.vertex_count(_event_graph(s, d)), f"SELECT count(*) AS n_vertices FROM {_IDS}"),
    "edge_count": (lambda s, d: algorithms.edge_count(_event_graph(s, d)), f"SELECT count(*) AS n_edges FROM {_EV}"),
    "in_degree": (lambda s, d: algorithms.in_degree(_event_graph(s, d)), _IN),
    "out_degree": (lambda s, d: algorithms.out_degree(_event_graph(s, d)), _DEG),
    "degree_distribution": (lambda s, d: algorithms.degree_distribution(algorithms.in_degree(_event_graph(s, d))), f"SELECT degree, count(*) AS n_vertices FROM ({_IN}) GROUP BY degree"),
    "hash_partition": (lambda s, d: algorithms.hash_partition(table(s, d, "part").select(F.col("p_partkey").alias("id")), 4), "SELECT p_partkey AS id, CAST(p_partkey % 4 AS INTEGER) AS pid FROM part"),
    "partition_stats": (partition_stats, f"WITH e AS (SELECT src % 4 AS p, dst % 4 AS q FROM {_EV}), v AS (SELECT id % 4 AS pid, count(*) AS n_vertices FROM {_IDS} GROUP BY 1), l AS (SELECT p AS pid, count(*) AS n FROM e WHERE p = q GROUP BY p), c AS (SELECT pid, count(*) AS n FROM (SELECT p AS pid FROM e WHERE p <> q UNION ALL SELECT q FROM e WHERE p <> q) GROUP BY pid) SELECT CAST(v.pid AS INTEGER) AS pid, n_vertices, coalesce(l.n, 0) AS n_local, coalesce(c.n, 0) AS n_cut, round(coalesce(c.n, 0) / (coalesce(l.n, 0) + coalesce(c.n, 0)), 9) AS cut_ratio FROM v LEFT JOIN l ON l.pid = v.pid LEFT JOIN c ON c.pid = v.pid"),
    "label_partition": (label_partition, None),
    "link_prediction_trained": (link_prediction_trained, None),
    "fennel_partition": (lambda s, d: algorithms.stream_partition(_event_graph(s, d), 4, "fennel", "event_id"), None),
    "ldg_partition": (lambda s, d: algorithms.stream_partition(_event_graph(s, d), 4, "ldg", "event_id"), None),
    "dense_ids": (lambda s, d: algorithms.dense_ids(_event_graph(s, d)), f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM {_IDS}"),
    "triangle_count": (lambda s, d: algorithms.triangle_count(views.copurchase(s, d)), f"SELECT count(*) AS n_triangles FROM ({_TRI.format(e=_CO)})"),
    "triangle_list": (lambda s, d: algorithms.triangles(_event_graph(s, d)), _TRI.format(e=_EVC)),
    "egonet": (lambda s, d: algorithms.egonets(_event_graph(s, d)), f"WITH e AS (SELECT DISTINCT src, dst FROM {_EV}) SELECT src AS ego, src AS u, dst AS v FROM e UNION SELECT x.src, x.dst, y.dst FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst"),
    "common_neighbours": (link_prediction, f"WITH d AS (SELECT a AS id, count(*) AS deg FROM {_SYM} GROUP BY a), s AS (SELECT x.a AS a, y.a AS b, count(*) AS common, sum(1 / ln(deg)) AS aa FROM {_SYM} x JOIN {_SYM} y ON x.b = y.b AND x.a < y.a JOIN d ON d.id = x.b GROUP BY 1, 2) SELECT s.a, s.b, common, round(common / (da.deg + db.deg - common), 8) AS jaccard, round(aa, 6) AS adamic_adar FROM s JOIN d da ON da.id = s.a JOIN d db ON db.id = s.b WHERE NOT EXISTS (SELECT 1 FROM {_EVC} e WHERE e.a = s.a AND e.b = s.b)"),
    "pagerank_distribution": (rank_distribution, _pagerank_sql(10).replace("SELECT id, round(rank, 8) AS rank FROM r10", "SELECT round(rank, 3) AS rank, count(*) AS n_vertices FROM r10 GROUP BY 1")),
    "graph_roundtrip": (graph_roundtrip, "SELECT 'n' || n_nationkey AS id, n_name AS n, r_name AS m, 'IN' AS type FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "property_graph_roundtrip": (property_graph_roundtrip, "SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderstatus = 'P'"),
    "text_attributes_roundtrip": (text_attributes_roundtrip, "SELECT p_partkey AS id, p_size AS a, p_size * 300 AS b FROM part"),
    "rdf_triples_roundtrip": (rdf_roundtrip, "SELECT n_name AS s, 'in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "json_attributes_roundtrip": (json_attributes_roundtrip, "SELECT p_partkey AS id, p_size AS size, p_brand AS brand FROM part"),
    "xml_attributes_roundtrip": (xml_attributes_roundtrip, "SELECT p_partkey AS id, p_size AS size, p_brand AS brand FROM part"),
    "rdf_xml_roundtrip": (rdf_xml_roundtrip, "WITH x AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS title, CAST(l_partkey AS VARCHAR) AS p FROM lineitem) SELECT a.title, a.p AS a, b.p AS b FROM x a JOIN x b ON a.title = b.title AND a.p < b.p"),
    "parameters": (parameters, "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (3, 9)"),
    "catalog_list": (catalog_list, "SELECT * FROM (VALUES (1, 'events', 'op', true), (2, 'people', 'op', true)) AS t(id, name, status, is_directed)"),
    "citation_roundtrip": (citation_roundtrip, "SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem"),
    "pagerank_10": (pagerank_10, _pagerank_sql(10)),
    "knn_l2": (knn_l2, "SELECT e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) ** 2, 5) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id LIMIT 10"),
    "cosine_topk": (cosine_topk, "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 10"),
    "cosine_similarity": (cosine_to_first, "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"),
    "beam_search": (beam_search, None),
    "stream_ingest_dedup": (_stream(_stream_dedup), f"SELECT type, count(*) AS n FROM {_EV} GROUP BY type"),
    "stream_triangles": (_stream(_stream_triangles), f"SELECT count(*) AS n_triangles FROM ({_TRI.format(e=_EVC)})"),
    "stream_triangles_recount": (_stream(_stream_recount), f"SELECT count(*) AS n_triangles FROM ({_TRI.format(e=_EVC)})"),
    "stream_windows": (stream_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS type, count(*) AS n_edges FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2"),
    "stream_degree": (_stream(_stream_degree), f"SELECT src AS id, count(*) AS n_edges FROM {_EV} GROUP BY src"),
    "edge_list_export_roundtrip": (edge_list_roundtrip, f"SELECT src, dst FROM {_EV}"),
    "kg_canonicalise": (kg_canonicalise, "SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || ' / -X-'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part"),
    "kg_build": (kg_build, f"WITH w AS (SELECT regexp_extract_all(s, '\\S+') AS w FROM (SELECT unnest(regexp_split_to_array(text, '[.\\n]+')) AS s FROM benchmark)), t AS (SELECT DISTINCT {_canonical('w[1] || ' + chr(39) + '_Entity' + chr(39))} AS src, {_canonical('w[2]')} AS type, {_canonical('array_to_string(w[3:], ' + chr(39) + ' ' + chr(39) + ') || ' + chr(39) + '_Entity' + chr(39))} AS dst FROM w WHERE len(w) >= 3) SELECT type, count(*) AS n FROM t GROUP BY type"),
    "text_chunks": (text_chunks, "SELECT doc_id, CAST(c AS INTEGER) AS chunk, CAST(c * 500 AS INTEGER) AS start, length(substring(text, CAST(c * 500 + 1 AS BIGINT), 500)) AS n FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS c FROM documents WHERE length(text) > 0)"),
    "federated_mean": (federated_mean, "SELECT CAST(i - 1 AS INTEGER) AS i, round(avg(CAST(w AS DOUBLE)), 8) AS weight FROM (SELECT unnest(embedding) AS w, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i"),
}
_VIEWS = {"commerce": views.commerce, "copurchase": views.copurchase_graph}


def _cypher(view: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compiler.run(spark, _VIEWS[view](spark, sf_dir), text, procedures=PROCEDURES).rows

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _cypher(view, text) for name, (view, text, _) in CYPHER.items()}
QUERIES |= {name: _update(update, read) for name, (update, read, _) in UPDATES.items()}
QUERIES |= {name: f for name, (f, _) in FUNCTIONS.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, sql) in (CYPHER | UPDATES).items()} | {name: sql for name, (_, sql) in FUNCTIONS.items() if sql}
