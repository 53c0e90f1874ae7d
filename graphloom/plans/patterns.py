"""Queries in Cypher on the star-schema graph, each with equivalent SQL: projections, joins, aggregation, order, functions."""

from __future__ import annotations

from ..cypher import run
from .star import CODE_SQL, code, star

#: name -> (Cypher, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "flagship": (
        "MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION)-[:IN_REGION]->(r:REGION) WHERE c.balance > 0 RETURN r.name AS region, n.name AS nation, count(c) AS customers",
        "SELECT r_name AS region, n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY 1, 2",
    ),
    "prj1_label_scan": ("MATCH (n:NATION) RETURN n.id AS id, n.name AS name", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"),
    "prj2_all_nodes": ("MATCH (n) RETURN labels(n)[0] AS label, count(n) AS n", "SELECT 'REGION' AS label, count(*) AS n FROM region UNION ALL SELECT 'NATION', count(*) FROM nation UNION ALL SELECT 'CUSTOMER', count(*) FROM customer UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier UNION ALL SELECT 'PART', count(*) FROM part UNION ALL SELECT 'ORDER', count(*) FROM orders"),
    "prj3_label_conjunction": ("MATCH (n:PARTY:SUPPLIER) WHERE n:SUPPLIER OR (n:CUSTOMER AND n.balance > 0) RETURN n.id AS id, n.name AS name", "SELECT s_suppkey AS id, s_name AS name FROM supplier"),
    "prj4_property_map": ("MATCH (c:CUSTOMER {segment: 'BUILDING', nation: 3}) RETURN c.id AS id", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "prj5_comparison": ("MATCH (o:ORDER) WHERE o.status <> 'F' AND o.total >= 100000 AND o.total < 250000 RETURN o.id AS id, o.status AS status", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 100000 AND o_totalprice < 250000"),
    "prj6_starts_with": ("MATCH (p:PART) WHERE p.brand STARTS WITH 'Brand#1' RETURN p.id AS id, p.brand AS brand", "SELECT p_partkey AS id, p_brand AS brand FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    "prj7_contains": ("MATCH (c:CUSTOMER) WHERE c.name CONTAINS '12' RETURN c.id AS id", "SELECT c_custkey AS id FROM customer WHERE contains(c_name, '12')"),
    "prj8_regex": ("MATCH (n:NATION) WHERE n.name =~ '(?i)nation_1[0-9]' RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, '(?i)nation_1[0-9]')"),
    "prj9_in_list": ("MATCH (c:CUSTOMER) WHERE c.segment IN ['BUILDING', 'MACHINERY'] AND NOT c.nation IN [1, 2, 3] RETURN c.id AS id", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)"),
    "prj10_null_tests": ("MATCH (n:NATION) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:SUPPLIER) WHERE s.balance > 9000 WITH n, s WHERE s.id IS NULL RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)"),
    "prj11_label_predicate": ("MATCH (n) WHERE NOT n:PLACE AND NOT n:PART AND NOT n:ORDER RETURN labels(n)[0] AS label, n.id AS id", "SELECT 'CUSTOMER' AS label, c_custkey AS id FROM customer UNION ALL SELECT 'SUPPLIER', s_suppkey FROM supplier"),
    "prj12_projection": ("MATCH (p:PART) RETURN p.name AS name, p.size * 2 + 1 AS twice, p.size", 'SELECT p_name AS name, CAST(p_size * 2 + 1 AS BIGINT) AS twice, p_size AS "p.size" FROM part'),
    "prj13_distinct": ("MATCH (c:CUSTOMER) RETURN DISTINCT c.segment AS segment, c.nation AS nation", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer"),
    "prj14_with": ("MATCH (c:CUSTOMER)-[:PLACED]->(o:ORDER) WITH c, count(o) AS orders WHERE orders > 12 MATCH (c)-[:IN_NATION]->(n:NATION) RETURN c.id AS id, n.name AS nation, orders", "SELECT c_custkey AS id, n_name AS nation, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 HAVING count(*) > 12"),
    "prj15_case": ("MATCH (o:ORDER) RETURN CASE o.status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank, count(*) AS n FROM orders GROUP BY 1"),
    "prj17_pattern_predicate": ("MATCH (p:PART) WHERE NOT (p)<-[:CONTAINS_ITEM]-() OR p.size = 1 RETURN p.id AS id", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) OR p_size = 1"),
    "prj18_exists": (
        "MATCH (c:CUSTOMER) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:ORDER) WHERE o.total > 200000 } AND NOT EXISTS { MATCH (c)-[:PLACED]->(o:ORDER) WHERE o.status = 'P' AND o.total > 300000 } RETURN c.id AS id",
        "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)",
    ),
    "prj19_list_predicate": ("MATCH (n) WHERE any(l IN labels(n) WHERE l IN ['PARTY', 'REGION']) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'REGION' AS label, count(*) AS n FROM region UNION ALL SELECT 'CUSTOMER', count(*) FROM customer UNION ALL SELECT 'SUPPLIER', count(*) FROM supplier"),
    "jn1_expand": ("MATCH (c:CUSTOMER)-[:IN_NATION]->(n:NATION) RETURN c.id AS customer, n.name AS nation", "SELECT c_custkey AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "jn2_reverse_expand": ("MATCH (r:REGION)<-[:IN_REGION]-(n) RETURN r.name AS region, n.id AS nation", "SELECT r_name AS region, CAST(n_nationkey AS BIGINT) AS nation FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "jn3_alternation": ("MATCH (a:CUSTOMER|SUPPLIER)-[e:IN_NATION|PLACED]->(b) RETURN type(e) AS type, labels(a)[0] AS label, count(*) AS n", "SELECT 'IN_NATION' AS type, 'CUSTOMER' AS label, count(*) AS n FROM customer UNION ALL SELECT 'IN_NATION', 'SUPPLIER', count(*) FROM supplier UNION ALL SELECT 'PLACED', 'CUSTOMER', count(*) FROM orders"),
    "jn4_any_type": ("MATCH (n:NATION)-[r]->() RETURN type(r) AS type, count(r) AS n", "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'HAS', count(*) FROM customer"),
    "jn5_multi_hop": ("MATCH (r:REGION)<-[:IN_REGION]-(n:NATION)<-[:IN_NATION]-(c:CUSTOMER) MATCH (c)-[:PLACED]->(o:ORDER) WHERE o.total > 400000 RETURN r.name AS region, c.id AS customer, o.id AS order", "SELECT r_name AS region, c_custkey AS customer, o_orderkey AS \"order\" FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    "jn7_cartesian": ("MATCH (a:REGION), (b:NATION) WHERE b.id < 5 RETURN a.id AS a, b.id AS b", "SELECT CAST(r_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM region, nation WHERE n_nationkey < 5"),
    "jn8_optional": ("MATCH (n:NATION) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:SUPPLIER) WHERE s.balance > 5000 RETURN n.name AS nation, s.id AS supplier", "SELECT n_name AS nation, s_suppkey AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000"),
    "jn9_semi_anti": ("MATCH (p:PART) WHERE (p)<-[:CONTAINS_ITEM]-(:ORDER {status: 'P'}) RETURN p.id AS id", "SELECT p_partkey AS id FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'P')"),
    "ag1_count": ("MATCH (o:ORDER)-[r:CONTAINS_ITEM]->(p:PART) RETURN count(*) AS rows, count(p) AS parts, count(r) AS items", "SELECT count(*) AS rows, count(*) AS parts, count(*) AS items FROM lineitem"),
    "ag2_count_distinct": ("MATCH (o:ORDER)-[:CONTAINS_ITEM]->(p:PART) RETURN count(DISTINCT p) AS parts, count(DISTINCT o) AS orders", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem"),
    "ag3_group_by": ("MATCH (c:CUSTOMER)-[:PLACED]->(o:ORDER) RETURN c.segment AS segment, o.status AS status, count(*) AS n", "SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"),
    "ag4_having": ("MATCH (p:PART)-[:SUPPLIED_BY]->(s:SUPPLIER) WITH p.brand AS brand, count(*) AS c WHERE c > 1000 RETURN brand, c", "SELECT p_brand AS brand, count(*) AS c FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) > 1000"),
    "ag5_collect": ("MATCH (r:REGION)<-[:IN_REGION]-(n:NATION) WITH r, collect(n.name ORDER BY n.id) AS names, collect(DISTINCT n.region) AS keys RETURN r.name AS region, toString(size(names)) + ':' + names[0] + ':' + names[-1] AS names, size(keys) AS keys", "SELECT r_name AS region, CAST(count(*) AS VARCHAR) || ':' || arg_min(n_name, n_nationkey) || ':' || arg_max(n_name, n_nationkey) AS names, CAST(count(DISTINCT n_regionkey) AS INTEGER) AS keys FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "ag9_histogram": ("MATCH ()-[r]->() RETURN type(r) AS type, count(*) AS n", "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS_ITEM', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'HAS', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)"),
    "ag10_unresolved_rate": ("MATCH (:ORDER)-[r:CONTAINS_ITEM]->(:PART) RETURN r.flag AS flag, r.status AS status, count(*) AS n", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "so1_order_by": ("MATCH (c:CUSTOMER) RETURN c.segment AS segment, c.id AS id ORDER BY c.segment DESC, c.balance * -1, c.id LIMIT 50", "SELECT c_mktsegment AS segment, c_custkey AS id FROM customer ORDER BY c_mktsegment DESC, c_acctbal * -1, c_custkey LIMIT 50"),
    "so2_limit": ("MATCH (n:NATION) RETURN n.id AS id ORDER BY id LIMIT 7", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation ORDER BY 1 LIMIT 7"),
    "so3_skip_limit": ("MATCH (o:ORDER) RETURN o.id AS id ORDER BY id SKIP 100 LIMIT 20", "SELECT o_orderkey AS id FROM orders ORDER BY 1 LIMIT 20 OFFSET 100"),
    "so4_top_k": ("MATCH (c:CUSTOMER)-[:PLACED]->(o:ORDER) WITH c, count(o) AS n WHERE n > 1 RETURN c.id AS id, n ORDER BY n DESC, id LIMIT 10", "SELECT c_custkey AS id, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, id LIMIT 10"),
    "so6_severity_order": ("MATCH (o:ORDER) WITH o.priority AS priority, count(*) AS n RETURN priority, n ORDER BY CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, priority LIMIT 3", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, 1 LIMIT 3"),
    "fn1_substring": ("MATCH (n:NATION) RETURN n.id AS id, substring(n.name, 3) AS tail, substring(n.name, 0, 3) AS head", "SELECT CAST(n_nationkey AS BIGINT) AS id, substr(n_name, 4) AS tail, substr(n_name, 1, 3) AS head FROM nation"),
    "fn2_size": ("MATCH (p:PART) RETURN p.id AS id, size(p.name) AS n", "SELECT p_partkey AS id, CAST(length(p_name) AS INTEGER) AS n FROM part"),
    "fn3_concat": ("MATCH (s:SUPPLIER) RETURN s.id AS id, s.name + '/' + s.nation AS path", "SELECT s_suppkey AS id, s_name || '/' || CAST(s_nationkey AS VARCHAR) AS path FROM supplier"),
    "fn4_type": ("MATCH (c:CUSTOMER {id: 1})-[r]->(x) RETURN type(r) AS type, x.id AS id", "SELECT 'IN_NATION' AS type, CAST(c_nationkey AS BIGINT) AS id FROM customer WHERE c_custkey = 1 UNION ALL SELECT t, o_orderkey FROM orders, (SELECT 'PLACED' AS t UNION ALL SELECT 'HAS') WHERE o_custkey = 1"),
    "fn5_labels": ("MATCH (n:PLACE) RETURN n.name AS name, labels(n)[0] AS first, size(labels(n)) AS n", "SELECT r_name AS name, 'REGION' AS first, 2 AS n FROM region UNION ALL SELECT n_name, 'NATION', 2 FROM nation"),
    "fn6_keys": ("MATCH (n:PLACE) UNWIND keys(n) AS k RETURN k, count(*) AS n", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT unnest(['id', 'name']) AS k, count(*) AS n FROM region UNION ALL SELECT unnest(['id', 'name', 'region']), count(*) FROM nation) GROUP BY 1"),
    "fn8_unwind": ("UNWIND [1, 5, 9] AS k MATCH (n:NATION) WHERE n.id = k RETURN k, n.name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey IN (1, 5, 9)"),
    "fn9_map_literal": ("MATCH (r:REGION) WITH {name: r.name, id: r.id} AS m RETURN m.name AS name, m.id AS id", "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS id FROM region"),
    "gt1_reachability": (
        "MATCH (r:REGION)-[:HAS*]->(x) RETURN DISTINCT r.id AS region, labels(x)[0] AS label, x.id AS id",
        "WITH RECURSIVE e(a, al, b, bl) AS (SELECT CAST(n_regionkey AS BIGINT), 'REGION', CAST(n_nationkey AS BIGINT), 'NATION' FROM nation UNION ALL SELECT c_nationkey, 'NATION', c_custkey, 'CUSTOMER' FROM customer UNION ALL SELECT o_custkey, 'CUSTOMER', o_orderkey, 'ORDER' FROM orders), t(region, id, label) AS (SELECT a, b, bl FROM e WHERE al = 'REGION' UNION SELECT region, b, bl FROM t JOIN e ON a = id AND al = label) SELECT region, label, id FROM t",
    ),
    "gt2_bounded": ("MATCH (r:REGION {id: 2})-[:HAS*1..2]->(x) RETURN r.id AS region, labels(x)[0] AS label, x.id AS id", "SELECT CAST(n_regionkey AS BIGINT) AS region, 'NATION' AS label, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'CUSTOMER', c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
}

#: on the cyclic graph
CYCLIC: dict[str, tuple[str, str]] = {
    "gt3_paths": (
        "MATCH p = (a:UNIT)-[:CALLS*1..3]->(b:UNIT) RETURN a.id AS a, b.id AS b, length(p) AS hops, count(*) AS paths",
        CODE_SQL + ", p AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE (x.a, x.b) <> (y.a, y.b) UNION ALL SELECT x.a, z.b, 3 FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a WHERE (x.a, x.b) <> (y.a, y.b) AND (y.a, y.b) <> (z.a, z.b) AND (x.a, x.b) <> (z.a, z.b)) SELECT a, b, hops, count(*) AS paths FROM p GROUP BY 1, 2, 3",
    ),
    "gt4_path_exists": ("MATCH (a:UNIT) WHERE EXISTS { MATCH (a)-[:CALLS*]->(b:UNIT) WHERE b.nation = 3 } RETURN a.id AS a", CODE_SQL + ", t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT DISTINCT a FROM t JOIN u ON u.id = t.b WHERE u.n = 3"),
    "gt7_transitive_importers": ("MATCH (a:UNIT {id: 30})<-[:CALLS*]-(b:UNIT) RETURN DISTINCT b.id AS id", CODE_SQL + ", t(b) AS (SELECT a FROM e WHERE b = 30 UNION SELECT e.a FROM t JOIN e ON e.b = t.b) SELECT b AS id FROM t"),
    "gt16_cycles": ("MATCH (a:UNIT)-[:CALLS*]->(a) RETURN DISTINCT a.id AS id", CODE_SQL + ", t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT DISTINCT a AS id FROM t WHERE a = b"),
}


def _query(graph, text):
    return lambda spark, sf_dir: run(graph(spark, sf_dir), spark, text)


QUERIES = {k: _query(star, q) for k, (q, _) in CYPHER.items()} | {k: _query(code, q) for k, (q, _) in CYCLIC.items()}
SQL = {k: s for k, (_, s) in (CYPHER | CYCLIC).items()}
