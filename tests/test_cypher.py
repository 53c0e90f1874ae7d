import pytest

from graphloom.cypher import CypherError, ReadOnlyError, explain, parse, run
from graphloom.graph import Edges, Graph, Nodes


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y.*")], "id string, n int, note string")
    t = spark.createDataFrame([("t", 9)], "id string, n int")
    e = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 3), ("c", "a", 4)], "s string, d string, w int")
    return Graph([Nodes("N", n, "id", ("CPG",)), Nodes("T", t, "id")], [Edges("E", e, "N", "N", "s", "d", ("w",))])


def rows(spark, graph, text, **params):
    return sorted((tuple(r) for r in run(graph, spark, text, params).collect()), key=repr)


def test_nulls_never_match(spark, graph):
    assert rows(spark, graph, "MATCH (n:N) WHERE n.note <> 'x' RETURN n.id AS id") == [("c",)]
    assert rows(spark, graph, "MATCH (n:N) WHERE n.note IS NULL RETURN n.id AS id") == [("a",)]
    assert rows(spark, graph, "MATCH (n:N {note: $v}) RETURN n.id AS id", v=None) == []


def test_parameters_are_values_not_text(spark, graph):
    assert rows(spark, graph, "MATCH (n:N) WHERE n.id IN $ids RETURN n.id AS id", ids=["a", "' OR true //"]) == [("a",)]
    with pytest.raises(CypherError):
        rows(spark, graph, "MATCH (n:N) WHERE n.id = $missing RETURN n")


def test_edges_of_one_match_differ(spark, graph):
    assert rows(spark, graph, "MATCH (a:N {id: 'a'})-[:E]->(b)<-[:E]-(c) RETURN c.id AS id") == [("a",), ("a",)]


def test_trails_and_reachability(spark, graph):
    assert rows(spark, graph, "MATCH (a:N {id: 'a'})-[:E*]->(x) RETURN DISTINCT x.id AS id") == [("a",), ("b",), ("c",)]
    assert rows(spark, graph, "MATCH p = (a:N {id: 'a'})-[:E*1..3]->(x) RETURN x.id AS id, length(p) AS n") == [("a", 3), ("a", 3), ("b", 1), ("b", 1), ("c", 2), ("c", 2)]
    assert rows(spark, graph, "MATCH (a:N {id: 'a'})-[:E*0..1]->(x) RETURN DISTINCT x.id AS id") == [("a",), ("b",)]


def test_either_direction_and_bound_ends(spark, graph):
    assert rows(spark, graph, "MATCH (b:N {id: 'b'})--(x) RETURN DISTINCT x.id AS id") == [("a",), ("c",)]
    assert rows(spark, graph, "MATCH (a:N)-[:E]->(b:N), (b)-[:E]->(c:N), (c)-[:E]->(a) RETURN count(*) AS n") == [(6,)]


def test_writes_are_refused():
    for text in ("CREATE (n)", "MATCH (n) DETACH DELETE n", "MATCH (n) SET n.x = 1 RETURN n"):
        with pytest.raises(ReadOnlyError):
            parse(text)


@pytest.mark.parametrize("text", ["MATCH (n", "RETURN", "MATCH (n) RETURN n.x AS", "FOO (n)", "MATCH (n)"])
def test_bad_queries(text):
    with pytest.raises(CypherError):
        parse(text)


def test_functions_and_lists(spark, graph):
    assert rows(spark, graph, "MATCH (n:T) RETURN substring('hello', 1, 3) AS s, size('hello') AS n, [x IN [1, 2, 3] WHERE x > 1 | x * 2] AS l, [1, 2][-1] AS last, coalesce(null, 4) AS c") == [("ell", 5, [4, 6], 2, 4)]


def test_procedures(spark, graph):
    assert rows(spark, graph, "CALL db.labels()") == [("CPG",), ("N",), ("T",)]
    assert rows(spark, graph, "CALL db.relationshipTypes() YIELD relationshipType") == [("E",)]


def test_explain_prunes_and_pushes(spark, small):
    from graphloom.plans.star import star

    text = explain(star(spark, small), spark, "MATCH (c:CUSTOMER) WHERE c.balance > 100 RETURN c.id AS id")
    assert "GreaterThan(c_acctbal,100.0)" in text and "c_mktsegment" not in text


def test_patterns_linked_by_equality_are_joined(spark, graph):
    text = "MATCH (a:N), (b:T) WHERE a.n + 8 = b.n RETURN a.id AS a, b.id AS b"
    assert rows(spark, graph, text) == [("a", "t")]
    plan = explain(graph, spark, text)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scalar(spark, graph):
    from graphloom.cypher import scalar

    assert scalar(graph, spark, "MATCH (n:N) RETURN count(n) AS n") == 3
    assert scalar(graph, spark, "MATCH (n:N {id: 'none'}) RETURN n.n AS n") == 0


def test_tables_are_opened_when_needed(spark):
    from graphloom.graph import Nodes as Table

    opened = []
    g = Graph([Table(x, lambda x=x: opened.append(x) or spark.createDataFrame([("a",)], "id string"), "id") for x in ("A", "B")], [])
    assert rows(spark, g, "MATCH (a:A) RETURN a.id AS id") == [("a",)] and opened == ["A"]
