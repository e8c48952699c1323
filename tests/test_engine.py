import dataclasses

import pytest

from quillon import Engine, IterationLimitExceeded, StratificationError, absent, agg, any_of, atom, each, let, span, where
from quillon.functions import scalars as S
from quillon.sources.tables import dump, rows, struct_of

_ = "_"


def made(spark, **facts):
    e = Engine(spark)
    for name, data in facts.items():
        e.relation(name, ", ".join(f"c{k} int" for k in range(len(data[0]))), data)
    return e


def got(e, name):
    return {tuple(r) for r in e.read(name).collect()}


def test_fizz_buzz(spark):
    e = Engine(spark)
    for n in ("number", "fizz", "buzz", "both", "other"):
        e.relation(n, "x int")
    e.rule(atom("number", "x"), span("x", 1, 16))
    e.rule(atom("fizz", "x"), atom("number", "x"), where("x % 3 = 0")).rule(atom("buzz", "x"), atom("number", "x"), where("x % 5 = 0"))
    e.rule(atom("both", "x"), atom("fizz", "x"), atom("buzz", "x")).rule(atom("other", "x"), atom("number", "x"), absent("fizz", "x"), absent("buzz", "x"))
    e.run()
    assert got(e, "both") == {(15,)}
    assert got(e, "other") == {(x,) for x in (1, 2, 4, 7, 8, 11, 13, 14)}


def test_closures(spark):
    e = made(spark, road=[(1, 2), (2, 3)], rail=[(3, 4), (4, 5)]).relation("path", "a int, b int")
    e.rule(atom("path", "a", "b"), any_of((atom("road", "a", "b"),), (atom("rail", "a", "b"),)))
    e.rule(atom("path", "a", "c"), atom("path", "a", "b"), any_of((atom("road", "b", "c"),), (atom("rail", "b", "c"),)))
    assert e.run().read("path").count() == 10


def test_reach_both_ways(spark):
    e = made(spark, edge=[(1, 2), (2, 3), (4, 5)]).relation("reach", "a int, b int")
    e.rule((atom("reach", "a", "b"), atom("reach", "b", "a")), atom("edge", "a", "b")).rule(atom("reach", "a", "c"), atom("reach", "a", "b"), atom("reach", "b", "c"))
    assert e.run().read("reach").count() == 13


def test_negation_forms(spark):
    e = made(spark, foo=[(0, 1), (1, 2), (10, 11), (100, 101)], bar=[(1, 2, 3), (10, 11, 13)]).relation("a", "x int, y int").relation("b", "x int, y int")
    e.rule(atom("a", "x", "y"), atom("foo", "x", "y"), absent("bar", "x", "y", _)).rule(atom("b", "x", "y"), atom("foo", "x", "y"), absent("bar", "x", "y", "y + 1"))
    e.run()
    assert got(e, "a") == {(0, 1), (100, 101)}
    assert got(e, "b") == {(0, 1), (10, 11), (100, 101)}


def test_aggregates_and_empty_groups(spark):
    e = made(spark, team=[(1,), (2,), (3,)], score=[(1, 10), (1, 20), (2, 25)])
    for n in ("best", "many"):
        e.relation(n, "t int, v int")
    e.rule(atom("best", "t", "v"), atom("team", "t"), agg("v", "max", "s", "score", "t", "s")).rule(atom("many", "t", "v"), atom("team", "t"), agg("v", "count", None, "score", "t", _))
    e.run()
    assert got(e, "best") == {(1, 20), (2, 25)}
    assert got(e, "many") == {(1, 2), (2, 1), (3, 0)}


def test_lattices(spark):
    e = made(spark, edge=[(1, 2, 1), (2, 3, 2), (1, 3, 10)]).relation("short", "a int, b int, w int", lattice="min")
    e.rule(atom("short", "a", "b", "w"), atom("edge", "a", "b", "w")).rule(atom("short", "a", "c", "v + w"), atom("short", "a", "b", "v"), atom("edge", "b", "c", "w"))
    assert got(e.run(), "short") == {(1, 2, 1), (2, 3, 2), (1, 3, 3)}


def test_errors(spark):
    e = made(spark, p=[(1,)])
    e.rule(atom("p", "x + 1"), atom("p", "x"))
    e.max_iterations = 3
    with pytest.raises(IterationLimitExceeded):
        e.run()
    e = made(spark, p=[(1,)], q=[(1,)])
    e.rule(atom("p", "x"), atom("q", "x"), absent("p", "x"))
    with pytest.raises(StratificationError):
        e.run()
    with pytest.raises(ValueError):
        e.rule(atom("nothing", "x"), atom("p", "x"))


def test_failures_drop_rows_and_integers_wrap(spark):
    e = made(spark, n=[(2147483647,), (0,), (-2147483648,)]).relation("o", "x int, y int").relation("d", "x int, y int").relation("r", "x int, y int")
    e.rule(atom("o", "x", "x + 1"), atom("n", "x")).rule(atom("d", "x", S.div("10", "x", "int")), atom("n", "x"))
    e.rule(atom("r", "x", "y"), atom("n", "x"), span("y", 5, 3))
    e.run()
    assert (2147483647, -2147483648) in got(e, "o")
    assert got(e, "d") == {(2147483647, 0), (-2147483648, 0)}
    assert not got(e, "r")


def test_generators_and_let(spark):
    e = Engine(spark).relation("p", "x int, y int")
    e.rule(atom("p", "x", "z"), each("x", "array(1, 2)"), let("z", "x * 10"), where("z > 10"))
    assert got(e.run(), "p") == {(2, 20)}


def test_increments(spark):
    e = Engine(spark).relation("raw", "x int").relation("out_of", "x int").relation("kept", "x int").relation("twice", "x int")
    e.rule(atom("kept", "x"), atom("raw", "x"), absent("out_of", "x")).rule(atom("twice", "2 * x"), atom("kept", "x"))
    e.insert("raw", [(1,), (2,)], "a")
    e.insert("out_of", [(2,)], "b")
    e.run()
    assert got(e, "twice") == {(2,)}
    e.insert("raw", [(3,), (1,)], "c")
    assert e.run_incremental() >= {"raw", "kept"}
    assert got(e, "twice") == {(2,), (6,)}
    e.retract_source("b")
    e.run_incremental()
    assert got(e, "twice") == {(2,), (4,), (6,)}
    e.retract_source("a")
    e.run_incremental()
    assert got(e, "twice") == {(6,)}


def test_sinks_and_structs(spark):
    @dataclasses.dataclass
    class Point:
        x: int
        y: int

    assert struct_of(Point).simpleString() == "struct<x:bigint,y:bigint>"
    e = made(spark, edge=[(2, 3), (1, 2)])
    e.run()
    assert list(rows(e, "edge")) == [(1, 2), (2, 3)]
    assert list(dump(e)) == ["edge(1, 2)", "edge(2, 3)"]
    assert e.query("edge", 1).count() == 1
