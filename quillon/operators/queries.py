"""One query for each operator, on the TPC-H-like tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions import scalars as S
from quillon.plans.engine import Engine, absent, agg, any_of, atom, each, let, span, where

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double",
}
#: Primary keys; (l_orderkey, l_linenumber) of lineitem isn't one.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(e: Engine, d: str, name: str) -> str:
    """Declare a driver table; only its columns above are read."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    e.relation(name, TABLES[name], e.spark.read.parquet(f"{d}/{name}.parquet").select(*columns), key=[KEYS[name]] if name in KEYS else None)
    return name


def query(name: str, schema: str, *rules, tables: tuple[str, ...], sql: str, more: dict[str, str] | None = None, lattices: dict[str, str] | None = None, facts: dict[str, list] | None = None) -> None:
    """Register the rules' relation `out`."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(spark)
        for t in tables:
            table(e, d, t)
        for n, kind in ((more or {}) | {"out": schema}).items():
            e.relation(n, kind, (facts or {}).get(n), lattice=(lattices or {}).get(n, ""))
        for head, *body in rules:
            e.rule(head, *body)
        return e.run().read("out")

    QUERIES[name], SQL[name] = build, sql


_ = "_"
C, O, N = atom("customer", "c", "n", "s"), atom("orders", "o", "c", "t"), atom("nation", "n", "m", "r")
L = atom("lineitem", "o", "p", "s", "l", "q")

query("proj_arith", "k bigint, v bigint, w int", (atom("out", "o * 2 + 1", "c - o", "cast(o AS int) * 1000003"), O), tables=("orders",),
      sql="SELECT DISTINCT o_orderkey * 2 + 1 AS k, o_custkey - o_orderkey AS v, CAST((((o_orderkey * 1000003 + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS w FROM orders")
query("scalar_div_rem", "k bigint, a bigint, b bigint, c bigint", (atom("out", "o", S.div("c - o", "c - 5"), S.rem("c - o", "c - 5"), S.shl("o", "c % 40")), O), tables=("orders",),
      sql="SELECT o_orderkey AS k, CAST(trunc((o_custkey - o_orderkey) / (o_custkey - 5)) AS BIGINT) AS a, (o_custkey - o_orderkey) % (o_custkey - 5) AS b, CAST(o_orderkey * power(2, o_custkey % 40) AS BIGINT) AS c FROM orders WHERE o_custkey != 5")
query("filter_cond", "k bigint, s string", (atom("out", "c", "s"), C, where("n > 5"), where(S.both("n < 20", "s != 'BUILDING'"))), tables=("customer",),
      sql="SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_nationkey > 5 AND c_nationkey < 20 AND c_mktsegment != 'BUILDING'")
query("let_binding", "k bigint, v bigint", (atom("out", "o", "v"), O, let("v", "c % 7"), let("v", "v * v + 1"), where("v > 2")), tables=("orders",),
      sql="SELECT o_orderkey AS k, (o_custkey % 7) * (o_custkey % 7) + 1 AS v FROM orders WHERE (o_custkey % 7) * (o_custkey % 7) + 1 > 2")
query("multi_head", "k bigint, v string", ((atom("out", "c", "s"), atom("out", "-c", "'n' || n")), C), tables=("customer",),
      sql="SELECT c_custkey AS k, c_mktsegment AS v FROM customer UNION SELECT -c_custkey, 'n' || c_nationkey FROM customer")
query("const_clause", "k bigint", (atom("out", "c"), atom("customer", "c", 3, "'BUILDING'")), tables=("customer",), sql="SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
query("repeated_var", "k int", (atom("out", "n"), atom("nation", "n", _, "n")), (atom("out", "n + 100"), atom("nation", "n", _, "n + 1")), tables=("nation",),
      sql="SELECT n_nationkey AS k FROM nation WHERE n_nationkey = n_regionkey UNION SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = n_nationkey + 1")
query("wildcard_distinct", "n int, s string", (atom("out", "n", "s"), atom("customer", _, "n", "s")), tables=("customer",), sql="SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer")
query("join_equi", "c bigint, m string", (atom("out", "c", "m"), C, atom("nation", "n", "m", _)), tables=("customer", "nation"), sql="SELECT c_custkey AS c, n_name AS m FROM customer JOIN nation ON c_nationkey = n_nationkey")
query("join_multi_key", "p bigint, s bigint, q double", (atom("out", "p", "s", "q"), atom("lineitem", "o", "p", "s", _, _), atom("lineitem", "o", "p", "s", 1, "q")), tables=("lineitem",),
      sql="SELECT DISTINCT b.l_partkey AS p, b.l_suppkey AS s, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE b.l_linenumber = 1")
query("join_expr_key", "o bigint, c bigint", (atom("out", "o", "c"), O, atom("customer", "c + 1", 4, _)), tables=("orders", "customer"), sql="SELECT o_orderkey AS o, o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey + 1 WHERE c_nationkey = 4")
query("join_theta", "a int, b int", (atom("out", "a", "b"), atom("nation", "a", _, "x"), atom("nation", "b", _, "y"), where("x < y AND a > b")), tables=("nation",),
      sql="SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
query("join_cross", "a string, b string", (atom("out", "a", "b"), atom("nation", _, "a", _), atom("region", _, "b")), tables=("nation", "region"), sql="SELECT DISTINCT n_name AS a, r_name AS b FROM nation, region")
query("join_threeway", "c bigint, r string", (atom("out", "c", "w"), C, atom("nation", "n", _, "r"), atom("region", "r", "w")), tables=("customer", "nation", "region"),
      sql="SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
query("semi_probe", "c bigint", (atom("out", "c"), C, atom("supplier", _, "n"), atom("orders", _, "c", "'O'")), tables=("customer", "supplier", "orders"),
      sql="SELECT c_custkey AS c FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
query("triangles", "a bigint, b bigint, c bigint", (atom("edge", "a", "b"), atom("lineitem", _, "p", "s", _, _), let("a", "p % 60"), let("b", "s % 60"), where("a < b")),
      (atom("out", "a", "b", "c"), atom("edge", "a", "b"), atom("edge", "b", "c"), atom("edge", "a", "c")), tables=("lineitem",), more={"edge": "a bigint, b bigint"},
      sql="WITH edge AS (SELECT DISTINCT l_partkey % 60 AS a, l_suppkey % 60 AS b FROM lineitem WHERE l_partkey % 60 < l_suppkey % 60) SELECT x.a AS a, x.b AS b, y.b AS c FROM edge x JOIN edge y ON x.b = y.a JOIN edge z ON z.a = x.a AND z.b = y.b")
query("neg_simple", "c bigint", (atom("out", "c"), C, absent("orders", _, "c", "'P'")), tables=("customer", "orders"), sql="SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
query("neg_wildcard", "p bigint", (atom("out", "p"), atom("part", "p", _, _), absent("lineitem", _, "p", _, 1, _)), tables=("part", "lineitem"), sql="SELECT p_partkey AS p FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
query("neg_expr", "c bigint", (atom("out", "c"), C, absent("orders", _, "c + 1", "t")), tables=("customer", "orders"), sql="SELECT c_custkey AS c FROM customer WHERE c_custkey + 1 NOT IN (SELECT o_custkey FROM orders)")
query("neg_all", "n int", (atom("out", "n"), N, absent("none", _)), (atom("out", "n + 1000"), N, absent("nation", _, _, _)), tables=("nation",), more={"none": "x int"}, sql="SELECT n_nationkey AS n FROM nation")
query("disj_union", "n int", (atom("out", "n"), any_of((atom("supplier", _, "n"), where("n < 5")), (atom("customer", _, "n", "'MACHINERY'"),))), tables=("supplier", "customer"),
      sql="SELECT s_nationkey AS n FROM supplier WHERE s_nationkey < 5 UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
query("set_intersect", "n int", (atom("out", "n"), atom("supplier", _, "n"), atom("customer", _, "n", "'MACHINERY'")), tables=("supplier", "customer"), sql="SELECT s_nationkey AS n FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
query("set_except", "p bigint", (atom("out", "s"), atom("supplier", "s", _), absent("lineitem", _, "s", _, 2, _)), tables=("supplier", "lineitem"), sql="SELECT s_suppkey AS p FROM supplier EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2")
query("gen_range", "n int, x int", (atom("out", "n", "x"), N, span("x", 0, "n - 3")), tables=("nation",), sql="SELECT n_nationkey AS n, CAST(x AS INTEGER) AS x FROM nation, generate_series(0, 30) g(x) WHERE x < n_nationkey - 3")
query("gen_dependent", "x int, y int", (atom("out", "x", "y"), span("x", 0, 10), span("y", "x + 1", 10, True)), tables=(), sql="SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM generate_series(0, 9) a(x), generate_series(1, 10) b(y) WHERE y > x")
query("gen_array", "n int, x int", (atom("out", "n", "x"), N, each("x", "array(3, 5, n)")), tables=("nation",), sql="SELECT n_nationkey AS n, 3 AS x FROM nation UNION SELECT n_nationkey, 5 FROM nation UNION SELECT n_nationkey, n_nationkey FROM nation")
for f, what in (("min", "min(c_nationkey)"), ("max", "max(c_nationkey)"), ("sum", "CAST(sum(c_nationkey) AS BIGINT)"), ("count", "count(*)")):
    query(f"agg_{f}", "v bigint", (atom("out", "v"), agg("v", f, None if f == "count" else "k", "t", _, "k")), (atom("t", "c", "n"), C), tables=("customer",), more={"t": "c bigint, n bigint"}, sql=f"SELECT CAST({what} AS BIGINT) AS v FROM customer")
query("agg_mean", "n int, v double", (atom("out", "n", "v"), N, agg("v", "mean", "c", "customer", "c", "n", _)), tables=("nation", "customer"), sql="SELECT c_nationkey AS n, CAST(sum(c_custkey) AS DOUBLE) / count(*) AS v FROM customer GROUP BY 1")
query("agg_grouped", "n int, v bigint, w bigint", (atom("out", "n", "v", "w"), N, agg("v", "max", "c", "customer", "c", "n", _), agg("w", "sum", "c", "customer", "c", "n", "'BUILDING'")), tables=("nation", "customer"),
      sql="SELECT c_nationkey AS n, max(c_custkey) AS v, CAST(sum(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') AS BIGINT) AS w FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_mktsegment = 'BUILDING') > 0")
query("agg_count_zero", "c bigint, v bigint", (atom("out", "c", "v"), C, agg("v", "count", None, "orders", _, "c", _)), tables=("customer", "orders"),
      sql="SELECT c_custkey AS c, CAST(count(o_orderkey) AS BIGINT) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
query("agg_cascade", "v bigint", (atom("best", "n", "m"), N, agg("m", "max", "c", "customer", "c", "n", _)), (atom("out", "v"), agg("v", "min", "m", "best", _, "m")), tables=("nation", "customer"), more={"best": "n int, m bigint"},
      sql="SELECT CAST(min(m) AS BIGINT) AS v FROM (SELECT max(c_custkey) AS m FROM customer GROUP BY c_nationkey)")
EDGES = (atom("edge", "a", "b"), atom("orders", _, "c", _), let("a", "c % 50"), let("b", "(c * 7 + 3) % 50"))
EDGES_SQL = "edge AS (SELECT DISTINCT o_custkey % 50 AS a, (o_custkey * 7 + 3) % 50 AS b FROM orders)"
PATH = {"edge": "a bigint, b bigint", "path": "a bigint, b bigint"}
TC_SQL = f"WITH RECURSIVE {EDGES_SQL}, path AS (SELECT a, b FROM edge UNION SELECT path.a, edge.b FROM path JOIN edge ON path.b = edge.a)"
query("tc_graph", "a bigint, b bigint", EDGES, (atom("out", "a", "b"), atom("edge", "a", "b")), (atom("out", "a", "c"), atom("out", "a", "b"), atom("edge", "b", "c")), tables=("orders",), more={"edge": PATH["edge"]}, sql=f"{TC_SQL} SELECT a, b FROM path")
query("reach_nonlinear", "a bigint, b bigint", EDGES, (atom("out", "a", "b"), any_of((atom("edge", "a", "b"),), (atom("edge", "b", "a"),))), (atom("out", "a", "c"), atom("out", "a", "b"), atom("out", "b", "c")), tables=("orders",), more={"edge": PATH["edge"]},
      sql=f"WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), path AS (SELECT a, b FROM both_ways UNION SELECT path.a, both_ways.b FROM path JOIN both_ways ON path.b = both_ways.a) SELECT a, b FROM path")
query("mutual_even_odd", "x int", (atom("odd", "x + 1"), atom("out", "x"), where("x < 20")), (atom("out", "x + 1"), atom("odd", "x"), where("x < 20")), tables=(), more={"odd": "x int"}, facts={"out": [(0,)]}, sql="SELECT CAST(x * 2 AS INTEGER) AS x FROM generate_series(0, 10) g(x)")
query("fibonacci", "n int, v int", (atom("out", "n", "a + b"), span("n", 2, 11), atom("out", "n - 1", "a"), atom("out", "n - 2", "b")), tables=(), facts={"out": [(0, 0), (1, 1)]},
      sql="WITH RECURSIVE f(n, v, w) AS (SELECT 0, 0, 1 UNION ALL SELECT n + 1, w, v + w FROM f WHERE n < 10) SELECT CAST(n AS INTEGER) AS n, CAST(v AS INTEGER) AS v FROM f")
query("factorial_wrap", "n int, f int", (atom("out", "n + 1", "(n + 1) * f"), atom("out", "n", "f"), where("n < 14")), tables=(), facts={"out": [(0, 1)]},
      sql="WITH RECURSIVE r(n, f) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, (((n + 1) * f + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM r WHERE n < 14) SELECT CAST(n AS INTEGER) AS n, CAST(f AS INTEGER) AS f FROM r")
query("lattice_max", "n int, v bigint", (atom("out", "n", "c"), C), tables=("customer",), lattices={"out": "max"}, sql="SELECT c_nationkey AS n, max(c_custkey) AS v FROM customer GROUP BY 1")
query("lattice_min_global", "v bigint", (atom("out", "o"), O), tables=("orders",), lattices={"out": "min"}, sql="SELECT min(o_orderkey) AS v FROM orders")
query("lattice_shortest", "a bigint, b bigint, w bigint", (atom("out", "a", "b", "c % 9 + 1"), atom("orders", _, "c", _), let("a", "c % 12"), let("b", "(c * 7 + 3) % 12")), (atom("out", "a", "c", "v + w"), atom("out", "a", "b", "v"), atom("out", "b", "c", "w")), tables=("orders",), lattices={"out": "min"},
      sql="WITH RECURSIVE edge AS (SELECT o_custkey % 12 AS a, (o_custkey * 7 + 3) % 12 AS b, min(o_custkey % 9 + 1) AS w FROM orders GROUP BY 1, 2), p(a, b, w) AS (SELECT a, b, w FROM edge UNION SELECT p.a, edge.b, p.w + edge.w FROM p JOIN edge ON p.b = edge.a WHERE p.w + edge.w < 120) SELECT a, b, min(w) AS w FROM p GROUP BY 1, 2")
query("components_min", "a bigint, m bigint", EDGES, (atom("reach", "a", "b"), any_of((atom("edge", "a", "b"),), (atom("edge", "b", "a"),))), (atom("low", "a", "a"), atom("reach", "a", _)), (atom("low", "b", "m"), atom("low", "a", "m"), atom("reach", "a", "b")), (atom("out", "a", "m"), atom("low", "a", "m")), tables=("orders",),
      more={"edge": PATH["edge"], "reach": PATH["edge"], "low": "a bigint, m bigint"}, lattices={"low": "min"},
      sql=f"WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), path AS (SELECT a, b FROM both_ways UNION SELECT path.a, both_ways.b FROM path JOIN both_ways ON path.b = both_ways.a) SELECT a, least(a, min(b)) AS m FROM path GROUP BY a")
query("agg_over_recursion", "v bigint", EDGES, (atom("path", "a", "b"), atom("edge", "a", "b")), (atom("path", "a", "c"), atom("path", "a", "b"), atom("edge", "b", "c")), (atom("out", "v"), agg("v", "count", None, "path", _, _)), tables=("orders",), more=PATH, sql=f"{TC_SQL} SELECT count(*) AS v FROM path")
query("option_match", "k bigint, v bigint", (atom("opt", "c", f"CASE WHEN n > 10 THEN {S.some('c * 2')} ELSE {S.none('bigint')} END"), C), (atom("out", "k", "x.value"), atom("opt", "k", "x"), where("x.some")), tables=("customer",), more={"opt": "k bigint, x struct<some: boolean, value: bigint>"},
      sql="SELECT c_custkey AS k, c_custkey * 2 AS v FROM customer WHERE c_nationkey > 10")
query("custom_type", "k bigint, v bigint", (atom("typed", "c", "named_struct('x', c, 'y', cast(n AS bigint))"), C), (atom("out", "k", "p.x + p.y"), atom("typed", "k", "p"), atom("typed", _, "p")), tables=("customer",), more={"typed": "k bigint, p struct<x: bigint, y: bigint>"},
      sql="SELECT c_custkey AS k, c_custkey + c_nationkey AS v FROM customer")


def _incremental(spark: SparkSession, d: str, retract: bool) -> DataFrame:
    e = Engine(spark)
    e.relation("edge", "a bigint, b bigint").relation("out", "a bigint, b bigint")
    e.rule(atom("out", "a", "b"), atom("edge", "a", "b")).rule(atom("out", "a", "c"), atom("out", "a", "b"), atom("edge", "b", "c"))
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey % 50 AS a", "(o_custkey * 7 + 3) % 50 AS b").distinct()
    e.insert("edge", rows.filter("a < 25"), "low")
    e.run()
    e.insert("edge", rows.filter("a >= 25"), "high")
    e.run_incremental()
    if retract:
        e.retract_source("low")
        e.run_incremental()
    return e.read("out")


QUERIES["incr_add"] = lambda spark, d: _incremental(spark, d, False)
SQL["incr_add"] = f"{TC_SQL} SELECT a, b FROM path"
QUERIES["incr_retract"] = lambda spark, d: _incremental(spark, d, True)
SQL["incr_retract"] = SQL["incr_add"].replace("FROM orders)", "FROM orders WHERE o_custkey % 50 >= 25)")
