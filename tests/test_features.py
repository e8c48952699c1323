"""Scalars, patterns, types, sources, streaming and the engine's own operations."""

import dataclasses
import math

import pytest

from quillon import Engine, agg, any_of, atom, each, let, where
from quillon.functions import patterns as P
from quillon.functions import scalars as S
from quillon.sources.tables import bind, objects
from quillon.streaming.increments import feed

_ = "_"


def got(e, name):
    return {tuple(r) for r in e.read(name).collect()}


def values(spark, terms, **rows):
    """What each term gives on one row, by a rule; a failed one is missing."""
    e = Engine(spark).relation("one", ", ".join(f"{n} {t}" for n, (t, _) in rows.items()), [tuple(v for _, v in rows.values())])
    for k, (kind, term) in enumerate(terms):
        e.relation(f"r{k}", f"v {kind}").rule(atom(f"r{k}", term), atom("one", *rows))
    e.run()
    return [next((r[0] for r in e.read(f"r{k}").collect()), None) for k in range(len(terms))]


def test_float_division_and_casts(spark):
    inf, nan, none, big, small, cut = values(
        spark,
        [("double", S.fdiv("x", "z")), ("double", S.fdiv("z", "z")), ("double", S.fdiv("x", "cast(null AS double)")), ("int", S.to_int("b")), ("int", S.to_int("-b")), ("tinyint", S.to_int("x * 100", "tinyint"))],
        x=("double", 7.5), z=("double", 0.0), b=("double", 1e20),
    )
    assert inf == math.inf and math.isnan(nan) and none is None
    assert (big, small, cut) == (2147483647, -2147483648, 127)
    assert values(spark, [("int", S.to_int("n")), ("bigint", S.to_int("m", "bigint"))], n=("double", math.nan), m=("double", -1e30)) == [0, -(1 << 63)]


def test_integers(spark):
    assert values(
        spark,
        [("int", "a & b"), ("int", "a | b"), ("int", "a ^ b"), ("int", "~a"), ("int", "abs(a)"), ("int", "abs(least)"), ("boolean", "not t"), ("boolean", "a = b"), ("int", "cast(3000000000 AS int)"), ("double", "cast(a AS double)")],
        a=("int", -6), b=("int", 3), least=("int", -(1 << 31)), t=("boolean", True),
    ) == [-6 & 3, -6 | 3, -6 ^ 3, 5, 6, -(1 << 31), False, False, -1294967296, -6.0]
    assert values(spark, [("bigint", S.shr("a", "2")), ("bigint", S.shr("a", "64")), ("int", S.shl("a", "31", "int")), ("int", S.shl("a", "32", "int")), ("bigint", S.unsigned("a", 8)), ("tinyint", "cast(a + 130 AS tinyint)")], a=("int", -7)) == [-2, None, -(1 << 31), None, 249, 123]
    assert values(spark, [("boolean", S.either("t", "f = 1")), ("boolean", S.either("f = 1", "t")), ("boolean", S.either("1 div (f - f) = 1", "t")), ("boolean", S.both("f = 1", "t"))], t=("boolean", True), f=("int", 0)) == [True, True, None, False]
    assert values(spark, [("bigint", S.div("a", "0")), ("bigint", S.rem("-a", "3")), ("int", S.div("b", "-1", "int"))], a=("int", 7), b=("int", -(1 << 31))) == [None, -1, None]


def test_patterns(spark):
    e = Engine(spark).relation("opt", "k int, x struct<some: boolean, value: int>", [(1, (True, 5)), (2, (False, None)), (3, (True, 9))])
    for n in ("some", "first", "whole", "lost", "asked"):
        e.relation(n, "k int, v int")
    e.rule(atom("some", "k", "v"), atom("opt", "k", "x"), P.matching("x", P.some("v")))
    e.rule(atom("first", "k", "v"), atom("opt", "k", "x"), P.matching("named_struct('a', k, 'b', x)", P.one_of(P.of_type(a=1, b=P.some("v")), P.of_type(a="v"))))
    e.rule(atom("whole", "k", "w.value"), atom("opt", "k", "x"), P.matching("x", P.bound("w", P.some(9))))
    e.rule(atom("lost", "k", "0"), P.matched_atom("opt", "k", P.none()))
    e.rule(atom("asked", "k", "v"), P.matched_atom("opt", "k", P.some("v")), where("v > 5"))
    e.run()
    assert got(e, "some") == {(1, 5), (3, 9)}
    assert got(e, "first") == {(1, 5), (2, 2), (3, 3)}
    assert got(e, "whole") == {(3, 9)}
    assert got(e, "lost") == {(2, 0)}
    assert got(e, "asked") == {(3, 9)}
    with pytest.raises(ValueError):
        P.one_of("a", "b")


def test_booleans_as_terms(spark):
    e = Engine(spark).relation("p", "x int, b boolean", [(1, True), (2, False)]).relation("q", "x int").relation("r", "x int")
    e.rule(atom("q", "x"), atom("p", "x", "true")).rule(atom("r", "x"), P.matched_atom("p", "x", P._of("false")))
    e.run()
    assert (got(e, "q"), got(e, "r")) == ({(1,)}, {(2,)})


def test_registered_type(spark):
    e = Engine(spark).register_type("Even", "x int, y int", "x % 2 = 0").relation("n", "x int", [(1,), (2,), (4,)]).relation("p", "k int, v struct<x: int, y: int>").relation("back", "x int, y int")
    e.rule(atom("p", "x", "Even(x, x * 10)"), atom("n", "x")).rule(atom("back", "a", "b"), P.matched_atom("p", _, P.of_type(x="a", y="b")))
    assert got(e.run(), "back") == {(2, 20), (4, 40)}

    @dataclasses.dataclass
    class Pair:
        x: int
        y: int

    assert list(objects(e, "back", Pair)) == [Pair(2, 20), Pair(4, 40)]


def test_dual_and_orders(spark):
    e = Engine(spark).relation("edge", "a int, b int, w int", [(1, 2, 1), (2, 3, 2), (1, 3, 10)]).relation("short", "a int, b int, d struct<dual: int>", lattice="max")
    e.rule(atom("short", "a", "b", S.dual("w")), atom("edge", "a", "b", "w"))
    e.rule(atom("short", "a", "c", S.dual("v + w")), P.matched_atom("short", "a", "b", P.dual("v")), atom("edge", "b", "c", "w"))
    assert {(r.a, r.b, r.d.dual) for r in e.run().read("short").collect()} == {(1, 2, 1), (2, 3, 2), (1, 3, 3)}
    with pytest.raises(ValueError):
        e.relation("bad", "k int, v map<int, int>", lattice="max")


def test_reads(spark):
    e = Engine(spark).relation("p", "x int, y string", [(1, "a"), (2, "b"), (2, "b")]).relation("none", "x int")
    assert e.contains("p", 1, "a") and not e.contains("p", 1, "b")
    assert [tuple(r) for r in e.lookup("p", "y", "b").collect()] == [tuple(r) for r in e.lookup("p", 0, 2).collect()] == [(2, "b")]
    assert (e.count("p"), e.is_empty("p"), e.is_empty("none")) == (2, False, True)


def test_update_program(spark):
    e = Engine(spark).relation("edge", "a int, b int", [(1, 2), (2, 3)]).relation("path", "a int, b int")
    one = (atom("path", "a", "b"), atom("edge", "a", "b"))
    e.rule(*one).run()
    assert e.count("path") == 2
    e.update_program([one, (atom("path", "a", "c"), atom("edge", "a", "b"), atom("path", "b", "c")), (atom("ends", "b"), atom("path", _, "b"))], {"ends": "b int", "edge": "a int"})
    assert e.count("path") == 2
    e.insert("edge", [(3, 4)])
    e.run_incremental()
    assert e.run().count("path") == 6 and got(e, "ends") == {(2,), (3,), (4,)}
    with pytest.raises(ValueError):
        e.update_program([(atom("nothing", "a"), atom("edge", "a", "b"))])
    assert e.run().count("path") == 6


def test_clear_and_close(spark):
    with Engine(spark) as e:
        e.relation("p", "x int", [(1,)]).relation("q", "x int").rule(atom("q", "x"), atom("p", "x")).rule(atom("q", "x + 1"), atom("q", "x"), where("x < 3"))
        assert e.run().count("q") == 3
        e.clear("p")
        e.run_incremental()
        assert e.is_empty("q") and e.is_empty("p")
        assert e.written
    assert not e.written


def test_sources_of_a_row(spark):
    """The first source counts; a retraction takes only its own rows, and what rules made of them stays until they run."""
    e = Engine(spark).relation("p", "x int").relation("q", "x int").rule(atom("q", "x"), atom("p", "x"))
    e.insert("p", [(1,), (2,)], "a")
    e.insert("p", [(2,), (3,)], "b")
    e.insert("p", [(3,), (4,)], "c")
    e.run()
    e.retract_source("b")
    assert got(e, "p") == {(1,), (2,), (4,)} and e.count("q") == 4
    e.run_incremental()
    assert got(e, "q") == {(1,), (2,), (4,)}
    e.retract_source("a")
    e.run_incremental()
    assert got(e, "q") == {(4,)}


def test_lattices_in_increments(spark):
    e = Engine(spark).relation("given", "k int, v int", [(1, 5)]).relation("best", "k int, v int", lattice="max").relation("seen", "k int, v int")
    e.rule(atom("best", "k", "v"), atom("given", "k", "v")).rule(atom("seen", "k", "v"), atom("best", "k", "v"))
    e.run()
    e.insert("given", [(1, 9), (2, 1)])
    e.run_incremental()
    assert got(e, "best") == got(e, "seen") == {(1, 9), (2, 1)}


def test_rules_see_sets(spark):
    """Rows given twice count once, and generators over struct fields, alternatives and unknown aggregates."""
    e = Engine(spark).relation("p", "x int, y int", spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x int, y int")).relation("n", "v int").relation("s", "v bigint").relation("f", "v int").relation("u", "v int")
    e.rule(atom("n", "v"), agg("v", "count", None, "p", _, _)).rule(atom("s", "v"), agg("v", "sum", "x", "p", "x", _))
    e.rule(atom("f", "v"), atom("p", "x", "y"), let("t", "named_struct('a', x, 'b', y)"), each("v", "t"))
    e.rule(atom("u", "v"), any_of((atom("p", "v", _),), (atom("p", _, "v"),)))
    e.run()
    assert (got(e, "n"), got(e, "s"), got(e, "f"), got(e, "u")) == ({(2,)}, {(4,)}, {(1,), (2,), (3,), (4,)}, {(1,), (2,), (3,), (4,)})
    e.rule(atom("n", "v"), agg("v", "median", "x", "p", "x", _))
    with pytest.raises(ValueError):
        e.run()


def test_scans_get_filters_and_nothing_is_written(spark):
    e = Engine(spark)
    bind(e, "customer", "/root/testdata/sf0.001/customer.parquet", {"c_custkey": "bigint", "c_nationkey": "int"}, key=["c_custkey"])
    e.relation("out", "k bigint").rule(atom("out", "c"), atom("customer", "c", 3))
    plan = e.run().read("out")._jdf.queryExecution().toString()
    assert "EqualTo(c_nationkey,3)" in plan and "Exchange" not in plan and not e.written


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 2), (2, 3)], "a int, b int").write.parquet(str(tmp_path / "in/first"))
    e = Engine(spark).relation("edge", "a int, b int").relation("path", "a int, b int")
    e.rule(atom("path", "a", "b"), atom("edge", "a", "b")).rule(atom("path", "a", "c"), atom("path", "a", "b"), atom("edge", "b", "c"))
    e.run()
    for k, rows in enumerate(([], [(3, 4)])):
        if rows:
            spark.createDataFrame(rows, "a int, b int").write.parquet(str(tmp_path / f"in/more{k}"))
        stream = spark.readStream.schema("a int, b int").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = feed(stream, e, "edge", str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
    assert got(e, "path") == {(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (1, 4)}
