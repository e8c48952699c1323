"""Relations from DataFrames, files and dataclasses, and relations as sorted text."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quillon.plans.engine import Engine

_KINDS = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def bind(engine: Engine, name: str, path: str, columns: dict[str, str], format: str = "parquet", key: Iterable[str] | None = None, **options: str) -> None:
    """A relation of some columns of a file source, cast to the given types; only those columns are read, with the filters that rules put on them. key: columns that are unique, if the caller knows any."""
    df = engine.spark.read.format(format).options(**options).load(path).select(*columns)
    engine.relation(name, ", ".join(f"`{c}` {t}" for c, t in columns.items()), df, key=key)


def struct_of(kind: type) -> T.StructType:
    """The struct type of a dataclass with plain fields; comparison is by fields in order."""
    hints = {f.name: f.type if isinstance(f.type, type) else {"int": int, "float": float, "str": str, "bool": bool}[f.type] for f in dataclasses.fields(kind)}
    return T.StructType([T.StructField(n, _KINDS[t], False) for n, t in hints.items()])


def rows(engine: Engine, name: str) -> Iterator[tuple]:
    """A relation's rows in order, fetched one partition at a time."""
    df = engine.read(name)
    return map(tuple, df.orderBy(*df.columns).toLocalIterator())


def objects(engine: Engine, name: str, kind: type) -> Iterator:
    """A relation's rows in order as objects of a dataclass; a relation of one struct column gives its fields."""
    for row in rows(engine, name):
        yield kind(*(row[0] if len(row) == 1 and isinstance(row[0], tuple) else row))


def dump(engine: Engine) -> Iterator[str]:
    for name in sorted(engine.relations):
        for row in rows(engine, name):
            yield f"{name}({', '.join(map(repr, row))})"


def session(app: str = "quillon") -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").getOrCreate()
