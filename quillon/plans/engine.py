"""Rules over DataFrames: joins, negation, aggregates, generators, recursion and lattices.

A relation is a set of rows without nulls. A rule derives rows of its heads from a
body, and each body item is a step on a DataFrame whose columns are the rule's
variables: a join for an atom, left_anti for an absence, a grouped join for an
aggregate, explode for a generator. What a body means is left to Catalyst; the
engine adds what SQL lacks: strata in order of dependence, and a semi-naive loop for
recursive ones, where each round joins only the rows that the round before found
and keeps those not seen yet.

Given rows stay where they are: rules read the caller's DataFrames, so filters and
columns reach their scans, and a DataFrame must give the same rows each time. What
isn't recursive becomes part of the plans that use it. Only recursive relations and
those that several rules use are written, to the shared folder; `close` deletes them.
Frames may hold a row more than once; rows become distinct where that has a
meaning, and not where declared keys show that they are.

Terms are SQL text: a plain name is a variable, `_` matches anything, anything else
is an expression over variables (`n - 1`, `5`, `'a'`).
"""

from __future__ import annotations

import contextlib
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, _parse_datatype_string

from quillon.plans.store import Table

MAX_RANGE = 1_000_000
MAX_PARTS = 12  # of a relation that grows in rounds, before they are written as one
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
_WORDS = re.compile(r"'[^']*'|[A-Za-z][A-Za-z0-9_]*")


class StratificationError(ValueError):
    """A relation depends on itself through negation or an aggregate."""


class IterationLimitExceeded(RuntimeError):
    pass


@dataclass(frozen=True)
class Atom:
    """Rows of a relation; as a head, what is derived."""

    name: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Absent(Atom):
    """No row of the relation matches; variables not bound yet match anything."""


@dataclass(frozen=True)
class Aggregate:
    """out = function over the matching rows, for each value of the variables bound before."""

    out: str
    function: str
    value: str | None
    of: Atom


@dataclass(frozen=True)
class Where:
    condition: str


@dataclass(frozen=True)
class Let:
    """variable = expression; takes the place of an earlier binding; a failed expression drops the row."""

    variable: str
    expression: str


@dataclass(frozen=True)
class Each:
    """variable runs over the elements of an array expression."""

    variable: str
    array: str


@dataclass(frozen=True)
class Any:
    """Alternatives, each a tuple of body items."""

    bodies: tuple[tuple, ...]


def atom(name: str, *terms: object) -> Atom:
    return Atom(name, tuple(map(str, terms)))


def absent(name: str, *terms: object) -> Absent:
    return Absent(name, tuple(map(str, terms)))


def agg(out: str, function: str, value: str | None, name: str, *terms: object) -> Aggregate:
    return Aggregate(out, function, value, atom(name, *terms))


def where(condition: str) -> Where:
    return Where(condition)


def let(variable: str, expression: object) -> Let:
    return Let(variable, str(expression))


def each(variable: str, array: str) -> Each:
    return Each(variable, array)


def span(variable: str, start: object, stop: object, inclusive: bool = False) -> Each:
    """Integers from start up to stop; a range that is empty, reversed or above a million has none."""
    n = f"({stop}) - ({start}) + {int(inclusive)}"
    return Each(variable, f"CASE WHEN {n} BETWEEN 1 AND {MAX_RANGE} THEN sequence({start}, {stop} - {int(not inclusive)}) END")


def any_of(*bodies: tuple) -> Any:
    return Any(bodies)


def is_name(term: str) -> bool:
    return bool(NAME.fullmatch(term)) and term not in ("true", "false")


def names_in(term: str) -> set[str]:
    """Names in an expression, outside its strings."""
    return {x for x in _WORDS.findall(term) if x[0] != "'"}


def renamed(term: str, to: dict[str, str]) -> str:
    return _WORDS.sub(lambda m: to.get(m[0], m[0]), term)


def _not_null(df: DataFrame) -> DataFrame:
    """Rows without nulls (NaN is a value). Unlike dropna() this reaches a scan."""
    return df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in df.columns)) if df.columns else df


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType) and kind.typeName() not in ("variant", "interval", "void")


def _expanded(body: tuple) -> list[tuple]:
    """Bodies without alternatives; items given as a tuple or list follow each other."""
    out: list[tuple] = [()]
    for item in body:
        if isinstance(item, tuple | list):
            out = [a + b for a in out for b in _expanded(tuple(item))]
            continue
        options = [b for x in item.bodies for b in _expanded(tuple(x))] if isinstance(item, Any) else [(item,)]
        out = [a + b for a in out for b in options]
    return out


@dataclass
class Rule:
    heads: tuple[Atom, ...]
    body: tuple

    def uses(self) -> Iterable[tuple[str, bool]]:
        """(relation, whether all its rows must be known first)."""
        for x in self.body:
            if isinstance(x, Aggregate):
                yield x.of.name, True
            elif isinstance(x, Atom):
                yield x.name, isinstance(x, Absent)


@dataclass
class Rows:
    """A relation's rows at some time: a frame, the positions of columns that no two of its rows agree on (None: rows may repeat), and the table where they are written, if they are."""

    frame: DataFrame
    key: tuple[int, ...] | None
    table: Table | None = None


@dataclass
class Relation:
    schema: StructType
    lattice: str = ""  # how the last column of rows with equal others merges: max or min
    key: tuple[int, ...] | None = None  # columns that the caller says are unique in what is given
    given: list[tuple[DataFrame, int | None, bool]] = field(default_factory=list)  # rows, their source, whether they are distinct
    full: Rows | None = None  # given and derived, as of the last run
    inserted: list[DataFrame] = field(default_factory=list)
    retracted: bool = False

    @property
    def names(self) -> list[str]:
        return self.schema.names

    @property
    def dual(self) -> bool:
        kind = self.schema.fields[-1].dataType if len(self.schema) else None
        return isinstance(kind, StructType) and kind.names == ["dual"]

    @property
    def best(self) -> str:
        """The aggregate that merges: a Dual's order is its value's, reversed."""
        return ("min" if self.lattice == "max" else "max") if self.dual else self.lattice


class Engine:
    def __init__(self, spark: SparkSession, max_iterations: int = 10_000):
        self.spark, self.max_iterations = spark, max_iterations
        self.relations: dict[str, Relation] = {}
        self.rules: list[Rule] = []
        self.sources: dict[str, int] = {}
        self.written: list[Table] = []

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete what the engine has written; frames of derived relations can't be read after that."""
        for t in self.written:
            t.drop()
        self.written = []

    # program

    def relation(self, name: str, schema: str, data: DataFrame | list | None = None, lattice: str = "", key: Iterable[str] | None = None) -> Engine:
        """Declare a relation. key: columns of which the given rows have no two values alike, if the caller knows that."""
        kind = _parse_datatype_string(schema)
        if lattice not in ("", "max", "min") or lattice and not len(kind):
            raise ValueError("a lattice merges its last column by max or min")
        if lattice and not _orderable(kind.fields[-1].dataType):
            raise ValueError(f"{name}: values of {kind.fields[-1].dataType.simpleString()} have no order, so they can't merge")
        self.relations[name] = Relation(kind, lattice, None if key is None else tuple(kind.names.index(c) for c in key))
        if data is not None:
            self.insert(name, data)
        return self

    def register_type(self, name: str, fields: str, valid: str = "true") -> Engine:
        """A type with a constructor: `name(...)` in any expression makes a struct of the fields, or fails where they aren't valid.

        It is a SQL function of the session, which Catalyst puts in line. patterns.of_type takes values apart.
        """
        kind = _parse_datatype_string(fields)
        made = ", ".join(f"'{f.name}', {f.name}" for f in kind)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kind)}) RETURNS {kind.simpleString()} RETURN CASE WHEN {valid} THEN named_struct({made}) END")
        return self

    def rule(self, heads: Atom | tuple[Atom, ...], *body) -> Engine:
        heads = heads if isinstance(heads, tuple) else (heads,)
        for b in _expanded(body):
            rule = Rule(heads, b)
            for name, n in [(h.name, len(h.terms)) for h in heads] + [(x.of.name, len(x.of.terms)) if isinstance(x, Aggregate) else (x.name, len(x.terms)) for x in b if isinstance(x, Atom | Aggregate)]:
                if name not in self.relations or len(self.relations[name].names) != n:
                    raise ValueError(f"{name} with {n} columns isn't declared")
            self.rules.append(rule)
        return self

    def update_program(self, rules: Iterable[tuple], relations: dict[str, str] | None = None) -> Engine:
        """Take these rules, each (heads, *body), in place of all others. Given rows stay, and so do derived ones until the next run; relations that aren't declared yet are."""
        for name, schema in (relations or {}).items():
            if name not in self.relations:
                self.relation(name, schema)
        before, self.rules = self.rules, []
        try:
            for heads, *body in rules:
                self.rule(heads, *body)
            self.strata()
        except ValueError:
            self.rules = before
            raise
        return self

    # rows

    def _frame(self, name: str, data: DataFrame | list) -> tuple[DataFrame, bool]:
        r = self.relations[name]
        if not isinstance(data, DataFrame):
            with contextlib.suppress(TypeError):  # values that have no hash
                data = list(dict.fromkeys(map(tuple, data)))
                return _not_null(self.spark.createDataFrame(data, r.schema)), True
            return _not_null(self.spark.createDataFrame(data, r.schema)), False
        if len(data.columns) != len(r.names):
            raise ValueError(f"{name} has {len(r.names)} columns")
        df = data.toDF(*[f"_{k}" for k in range(len(r.names))])
        return _not_null(df.select(*[F.col(f"_{k}").cast(f.dataType).alias(f.name) for k, f in enumerate(r.schema)])), r.key is not None

    def insert(self, name: str, data: DataFrame | list, source: str | None = None, written: bool = False) -> None:
        """Add rows; rows that are there already keep their first source. written: store them now, where the DataFrame can't be read again."""
        r = self.relations[name]
        number = None if source is None else self.sources.setdefault(source, len(self.sources))
        df, distinct = self._frame(name, data)
        if written:
            df = self._written(r, df)[0].frame()
        r.given.append((df, number, distinct))
        r.inserted.append(df)

    def retract_source(self, source: str) -> None:
        """Take out the rows that a source gave first; what they led to goes at the next run."""
        number = self.sources.get(source)
        for r in self.relations.values():
            if number is None or all(s != number for _, s, _ in r.given):
                continue
            kept: list[tuple[DataFrame, int | None, bool]] = []
            gone: list[DataFrame] = []
            for df, s, distinct in r.given:
                if s == number:
                    for other, _, _ in kept:
                        df = df.join(other, r.names, "left_anti")
                    gone.append(df)
                else:
                    for other in gone:
                        df = df.join(other, r.names, "left_anti")
                    kept.append((df, s, distinct))
            r.given, r.retracted = kept, True

    def clear(self, name: str) -> None:
        r = self.relations[name]
        r.given, r.inserted, r.retracted = [], [], True

    def _is_derived(self, name: str) -> bool:
        return any(h.name == name for r in self.rules for h in r.heads)

    def read(self, name: str) -> DataFrame:
        """A relation's rows: what is given now, or, for one that rules derive, what the last run gave."""
        r = self.relations[name]
        rows = r.full if r.full and (self._is_derived(name) or r.full.table) else self._given(r)
        return rows.frame if rows.key is not None else rows.frame.dropDuplicates()

    def query(self, name: str, *terms: object) -> DataFrame:
        """Rows that match a pattern of values and `_`; a shorter pattern matches the first columns."""
        df = self.read(name)
        for column, t in zip(df.columns, terms, strict=False):
            df = df if str(t) == "_" else df.filter(F.col(column) == F.expr(str(t)))
        return df

    def lookup(self, name: str, column: str | int, value: object) -> DataFrame:
        """Rows with this value in a column, given by name or position."""
        df = self.read(name)
        return df.filter(F.col(df.columns[column] if isinstance(column, int) else column) == F.lit(value))

    def contains(self, name: str, *values: object) -> bool:
        df = self.read(name)
        for column, v in zip(df.columns, values, strict=True):
            df = df.filter(F.col(column) == F.lit(v))
        return not df.isEmpty()

    def count(self, name: str) -> int:
        return self.read(name).count()

    def is_empty(self, name: str) -> bool:
        return self.read(name).isEmpty()

    # bodies

    @contextlib.contextmanager
    def _wrapping(self):
        """Expressions built inside wrap around instead of raising errors."""
        before = self.spark.conf.get("spark.sql.ansi.enabled")
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            self.spark.conf.set("spark.sql.ansi.enabled", before)

    def _matched(self, bound: set[str], source: Rows, a: Atom, bind: bool, joined: bool) -> tuple[DataFrame, str, dict[str, str]]:
        """rows with only what the atom uses; the join's condition; the variables it binds, by column. joined: others multiply its rows, so they are made distinct where columns went."""
        rows = source.frame
        names, keys, new, own = rows.columns, {}, {}, []
        for k, term in enumerate(a.terms):
            column = f"`{names[k]}`"
            if term == "_":
                continue
            if is_name(term):
                if term in bound:
                    keys[k] = term
                elif term in new:
                    own.append(f"{column} = {new[term][0]}")
                else:  # in an absence it matches anything, but the same thing each time
                    new[term] = (column, k)
            elif names_in(term) & bound:
                keys[k] = term
            else:
                own.append(f"{column} = ({renamed(term, {v: c for v, (c, _) in new.items()})})")
        for c in own:
            rows = rows.filter(c)
        kept = [*keys, *(k for _, k in new.values())] if bind else list(keys)
        if not kept:
            return rows.select(F.lit(1).alias("_one")).limit(1), "true", {}
        rows = rows.selectExpr(*[f"`{names[k]}` AS _r{k}" for k in kept])
        if bind and new and joined and len(kept) < len(names) and not (source.key is not None and set(source.key) <= set(kept)):
            rows = rows.dropDuplicates()
        return rows, " AND ".join(f"_r{k} = ({t})" for k, t in keys.items()), {v: f"_r{k}" for v, (_, k) in new.items()} if bind else {}

    def _step(self, df: DataFrame | None, item, rows: Rows | None, joined: bool) -> DataFrame:
        if isinstance(item, Where):
            return df.filter(item.condition)
        if isinstance(item, Let):
            df = df if df is not None else self.spark.range(1).select()
            return df.withColumn(item.variable, F.expr(item.expression)).filter(F.col(item.variable).isNotNull())
        if isinstance(item, Each):
            df = df if df is not None else self.spark.range(1).select()
            kind = df.schema[item.array].dataType if item.array in df.columns else None
            array = f"array({', '.join(f'{item.array}.`{n}`' for n in kind.names)})" if isinstance(kind, StructType) else item.array
            return df.select(*[c for c in df.columns if c != item.variable], F.explode(F.expr(array)).alias(item.variable))
        if isinstance(item, Aggregate):
            return self._aggregate(df, item, rows)
        bound = set(df.columns) if df is not None else set()
        found, on, new = self._matched(bound, rows, item, not isinstance(item, Absent), joined)
        if isinstance(item, Absent):
            df = df if df is not None else self.spark.range(1).select(F.lit(1).alias("_start"))
            return df.join(found, F.expr(on or "true"), "left_anti")
        made = [f"{c} AS `{v}`" for v, c in new.items()]
        if df is None:
            return found.selectExpr(*made) if new else found
        if not new:
            return df.join(found, F.expr(on or "true"), "left_semi")
        return (df.join(found, F.expr(on)) if on else df.crossJoin(found)).selectExpr(*[f"`{c}`" for c in df.columns], *made)

    def _aggregate(self, df: DataFrame | None, item: Aggregate, source: Rows) -> DataFrame:
        bound = df.columns if df is not None else []
        rows = source.frame
        if item.function in ("sum", "count", "mean") and source.key is None:
            rows = rows.dropDuplicates()
        names = [f"_g{k}" for k in range(len(rows.columns))]
        rows = rows.toDF(*names)
        keys = []
        inner: dict[str, str] = {}
        for column, term in zip(names, item.of.terms, strict=True):
            if term == "_":
                continue
            if is_name(term) and term not in bound:
                if term in inner:
                    rows = rows.filter(F.col(column) == F.col(inner[term]))
                inner.setdefault(term, column)
            elif is_name(term) or names_in(term) & set(bound):
                keys.append((column, F.expr(term)))
            else:
                rows = rows.filter(F.col(column) == F.expr(renamed(term, inner)))
        if item.function != "count" and item.value not in inner:
            raise ValueError(f"{item.value} isn't a free variable of {item.of}")
        value = F.col(inner[item.value]) if item.value else None
        made = {"min": F.min, "max": F.max, "sum": F.sum, "count": lambda _: F.count(F.lit(1)), "mean": lambda v: F.sum(v).cast("double") / F.count(v)}
        if item.function not in made:
            raise ValueError(f"no aggregate {item.function}")
        kind = dict(rows.dtypes)[inner[item.value]] if item.value and item.function in ("min", "max", "sum") else None
        result = made[item.function](value)
        result = (result.cast(kind) if kind else result).alias(item.out)
        base = [c for c in bound if c != item.out]
        if not keys:
            one = rows.agg(result).filter(F.col(item.out).isNotNull())
            return one if df is None else df.select(*base).crossJoin(F.broadcast(one))  # one row
        grouped = rows.groupBy(*[F.col(c).alias(f"{c}_key") for c, _ in keys]).agg(result)
        condition = F.lit(True)
        for c, e in keys:
            condition = condition & (F.col(f"{c}_key") == e)
        if item.function == "count":  # an empty group counts 0
            return df.select(*base).join(grouped, condition, "left").select(*base, F.coalesce(item.out, F.lit(0)).alias(item.out))
        return df.select(*base).join(grouped, condition).select(*base, item.out)

    def _derived(self, rule: Rule, state: dict[str, Rows], at: int = -1, delta: Rows | None = None) -> dict[str, list[DataFrame]]:
        """Rows of the heads; the body's item number `at` sees only delta, and comes first."""
        order = list(enumerate(rule.body))
        plain = all(type(x) in (Atom, Where) for x in rule.body)  # else what is bound before an item has a meaning
        if at > 0 and plain and all(t == "_" or is_name(t) or not names_in(t) for t in rule.body[at].terms):
            atoms = [x for x in order if isinstance(x[1], Atom) and x[0] != at]
            order = [order[at], *atoms, *[x for x in order if isinstance(x[1], Where)]]
        joined = sum(type(x) is Atom for x in rule.body) > 1
        df = None
        for k, item in order:
            name = item.of.name if isinstance(item, Aggregate) else item.name if isinstance(item, Atom) else None
            df = self._step(df, item, None if name is None else delta if k == at else state[name], joined)
        df = df if df is not None else self.spark.range(1).select(F.lit(1).alias("_start"))
        out: dict[str, list[DataFrame]] = {}
        for h in rule.heads:
            fields = self.relations[h.name].schema.fields
            out.setdefault(h.name, []).append(_not_null(df.select(*[F.expr(t).cast(f.dataType).alias(f.name) for t, f in zip(h.terms, fields, strict=True)])))
        return out

    def _is_distinct(self, rule: Rule, head: Atom, state: dict[str, Rows]) -> bool:
        """Whether keys show that the rule gives no row twice: what the head holds settles a key of each atom that can multiply rows."""
        seen: set[str] = set()
        several: list[Atom] = []
        for x in rule.body:
            if isinstance(x, Each) or isinstance(x, Let) and x.variable in seen or isinstance(x, Aggregate) and x.out in seen:
                return False
            if type(x) is Atom:
                new = {t for t in x.terms if is_name(t)} - seen
                several += [x] if new else []
                seen |= new
            elif isinstance(x, Let | Aggregate):
                seen.add(x.variable if isinstance(x, Let) else x.out)
        settled, open_, before = {t for t in head.terms if is_name(t)}, list(several), -1
        while len(settled) != before:
            before = len(settled)
            for x in list(open_):
                key = state[x.name].key
                if key is not None and all(x.terms[k] != "_" and names_in(x.terms[k]) - {"true", "false"} <= settled for k in key):
                    settled |= {t for t in x.terms if is_name(t)}
                    open_.remove(x)
        return not open_

    # evaluation

    def strata(self) -> list[set[str]]:
        """Relations that depend on each other together, after what they depend on."""
        need: dict[str, set[str]] = {n: set() for n in self.relations}
        for r in self.rules:
            for h in r.heads:
                need[h.name] |= {n for n, _ in r.uses()} | {x.name for x in r.heads}
        reach = {n: set(x) for n, x in need.items()}
        for via in need:  # transitive closure over relation names
            for n in need:
                if via in reach[n]:
                    reach[n] |= reach[via]
        groups, done = [], set()
        for n in sorted(need, key=lambda n: (len(reach[n]), n)):
            if n not in done:
                group = {n} | {m for m in reach[n] if n in reach[m]}
                groups.append(group)
                done |= group
        for r in self.rules:
            for n, before in r.uses():
                if before and any(h.name == n or h.name in reach[n] for h in r.heads):
                    raise StratificationError(f"{n} is negated or aggregated in its own definition")
        return groups

    def _given(self, r: Relation) -> Rows:
        """What was inserted and not retracted, as it is: no job runs."""
        if not r.given:
            return Rows(self.spark.createDataFrame([], r.schema), tuple(range(len(r.names))))
        df = r.given[0][0]
        for other, _, _ in r.given[1:]:
            df = df.unionByName(other)
        one = len(r.given) == 1 and r.given[0][2]
        return Rows(df, (r.key if r.key is not None else tuple(range(len(r.names)))) if one else None)

    def _merged(self, r: Relation, frames: list[DataFrame], distinct: bool = False) -> DataFrame:
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other)
        if not r.lattice:
            return df if distinct and len(frames) == 1 else df.dropDuplicates()
        *keys, value = r.names
        best = getattr(F, r.best)(value).alias(value)
        return df.groupBy(*keys).agg(best) if keys else _not_null(df.agg(best))

    def _fresh(self, r: Relation, rows: DataFrame, full: DataFrame | None) -> DataFrame:
        """Of merged rows, those that the relation doesn't have (for a lattice: that are better)."""
        if full is None:
            return rows
        if not r.lattice:
            return rows.join(full, r.names, "left_anti")
        *keys, value = r.names
        old = full.withColumnRenamed(value, "_old")
        better = F.col("_old").isNull() | (F.col(value) > F.col("_old") if r.best == "max" else F.col(value) < F.col("_old"))
        return (rows.join(old, keys, "left") if keys else rows.join(old, F.lit(True), "left")).filter(better).drop("_old").select(*r.names)

    def _written(self, r: Relation, df: DataFrame) -> tuple[Table, int]:
        table, n = Table(self.spark, r.schema).written(df)
        self.written.append(table)
        return table, n

    def _is_recursive(self, group: set[str]) -> bool:
        return any(h.name in group and n in group for r in self.rules for h in r.heads for n, _ in r.uses())

    def _state(self) -> dict[str, Rows]:
        return {n: r.full or self._given(r) for n, r in self.relations.items()}

    def _once(self, group: set[str], several: bool) -> None:
        """Relations that don't depend on themselves, as plans over what they use; several: they are used more than once, so what rules derive is written."""
        state = self._state()
        for n in group:
            r = self.relations[n]
            rules = [x for x in self.rules if any(h.name == n for h in x.heads)]
            if not rules and not r.lattice:
                r.full = self._given(r)
                continue
            frames = [df for df, _, _ in r.given] + [df for x in rules for df in self._derived(x, state)[n]]
            if not frames:
                r.full = self._given(r)
                continue
            distinct = not r.given and len(rules) == 1 and (h := [h for h in rules[0].heads if h.name == n])[1:] == [] and self._is_distinct(rules[0], h[0], state)
            df = self._merged(r, frames, distinct)
            r.full = Rows(df, tuple(range(len(r.names) - bool(r.lattice))))
            if several:
                table, _ = self._written(r, df)
                r.full = Rows(table.frame(), r.full.key, table)

    def _fixpoint(self, group: set[str], seed: dict[str, Rows] | None = None) -> dict[str, Table]:
        """Bring a stratum to its fixpoint; what came anew, by relation. seed: new rows of relations, the rest being derived already."""
        rules = [r for r in self.rules if any(h.name in group for h in r.heads)]
        state = self._state()
        found: dict[str, list[DataFrame]] = {n: [] for n in group}
        tables: dict[str, Table | None] = {n: self.relations[n].full.table if seed is not None else None for n in group}
        news: dict[str, Table] = {}
        own: set[str] = set()  # parts of these rounds, which nobody else reads

        def add(more: dict[str, list[DataFrame]]) -> None:
            for n, frames in more.items():
                if n in group:
                    found[n] += frames

        if seed is None:
            for n in group:
                found[n] += [df for df, _, _ in self.relations[n].given]
            for r in rules:
                if not any(n in group for n, _ in r.uses()):
                    add(self._derived(r, state))
        else:
            for n, rows in seed.items():
                if n in group:
                    found[n].append(rows.frame)
            for r in rules:
                for k, x in enumerate(r.body):
                    if type(x) is Atom and x.name in seed and x.name not in group:
                        add(self._derived(r, state, k, seed[x.name]))
        for n in group:
            if seed is None:
                state[n] = Rows(self.spark.createDataFrame([], self.relations[n].schema), ())
        for _ in range(self.max_iterations + 1):
            new: dict[str, Rows] = {}
            for n in group:
                if found[n]:
                    r = self.relations[n]
                    part, rows = self._written(r, self._fresh(r, self._merged(r, found[n]), tables[n] and state[n].frame))
                    if rows:
                        new[n] = Rows(part.frame(), tuple(range(len(r.names))), part)
                        news[n] = news[n].plus(part) if n in news else part
            if not new:
                break
            for n, rows in new.items():
                r, before = self.relations[n], tables[n]
                table = before.plus(rows.table) if before else rows.table
                if before and (r.lattice or len(table.parts) > MAX_PARTS):
                    table, _ = self._written(r, self._merged(r, [state[n].frame, rows.frame]) if r.lattice else table.frame())
                    own |= {*table.parts}
                    if set(before.parts) <= own:  # rewritten here before; nothing that is read later needs it
                        before.drop()
                tables[n] = table
                state[n] = Rows(table.frame() if table is not rows.table else rows.frame, tuple(range(len(r.names))), table)
            found = {n: [] for n in group}
            for r in rules:
                for k, x in enumerate(r.body):
                    if type(x) is Atom and x.name in new:
                        add(self._derived(r, state, k, new[x.name]))
            if not any(found.values()):
                break
        else:
            raise IterationLimitExceeded(f"no fixpoint within {self.max_iterations} rounds")
        for n in group:
            self.relations[n].full = Rows(state[n].frame, tuple(range(len(self.relations[n].names))), tables[n])
        return news

    def run(self) -> Engine:
        """Derive everything from the given rows."""
        groups = self.strata()
        recursive = {n for g in groups if self._is_recursive(g) for n in g}
        uses = Counter(n for r in self.rules for n, _ in r.uses() for _ in range(1 + any(h.name in recursive for h in r.heads)))
        with self._wrapping():
            for r in self.relations.values():
                r.full, r.inserted, r.retracted = None, [], False
            for group in groups:
                if group & recursive:
                    self._fixpoint(group)
                else:
                    self._once(group, any(uses[n] > 1 for n in group))
        return self

    def run_incremental(self) -> set[str]:
        """Derive what changed since the last run; the names of relations that were worked on.

        Where only rows were added, and only joins see them, their consequences are added. What depends on a
        retraction, or on a change through negation or an aggregate, is derived again.
        """
        worked: set[str] = set()
        again = {n for n, r in self.relations.items() if r.retracted}
        grown: dict[str, Rows] = {}
        with self._wrapping():
            for group in self.strata():
                rules = [r for r in self.rules if any(h.name in group for h in r.heads)]
                uses = {x for r in rules for x in r.uses()}
                inserted = {n: self.relations[n].inserted for n in group if self.relations[n].inserted}
                full = bool(group & again) or any(self.relations[n].full is None for n in group) or any(n in again or (before and n in grown) for n, before in uses)
                if not (full or inserted or any(n in grown for n, _ in uses)):
                    continue
                worked |= group
                if full:
                    if self._is_recursive(group):
                        self._fixpoint(group)
                    else:
                        self._once(group, True)
                    again |= group
                    continue
                seed = dict(grown)
                for n, frames in inserted.items():
                    r = self.relations[n]
                    part, rows = self._written(r, self._fresh(r, self._merged(r, frames), r.full.frame))
                    if rows:
                        seed[n] = Rows(part.frame(), tuple(range(len(r.names))), part)
                    if not rules and not r.lattice:  # only given rows: they are where they are
                        r.full = self._given(r)
                        if rows:
                            grown[n] = seed[n]
                if not rules and not any(self.relations[n].lattice for n in group):
                    continue
                for n in group:
                    r = self.relations[n]
                    if not r.full.table:
                        table, _ = self._written(r, r.full.frame if r.full.key is not None else r.full.frame.dropDuplicates())
                        r.full = Rows(table.frame(), tuple(range(len(r.names))), table)
                for n, table in self._fixpoint(group, seed).items():
                    if self.relations[n].lattice:
                        again.add(n)  # an improved value takes the place of one that others used
                    grown[n] = Rows(table.frame(), tuple(range(len(self.relations[n].names))), table)
            for r in self.relations.values():
                r.inserted, r.retracted = [], False
        return worked
