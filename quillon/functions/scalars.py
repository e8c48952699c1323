"""Scalar semantics of rules as SQL text: a failed evaluation is null, and a null drops the row.

Integers wrap around at their width (rules are analysed with ANSI mode off, where Spark's + - * do so). The
functions here are for where Spark differs: division, remainder, shifts, logic that fails from the left, casts.
"""

from __future__ import annotations

LOW = {"tinyint": -(1 << 7), "smallint": -(1 << 15), "int": -(1 << 31), "bigint": -(1 << 63)}
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _low(kind: str) -> str:
    return f"shiftleft(1L, 63)" if kind == "bigint" else f"({LOW[kind]})"  # noqa: F541


def div(a: str, b: str, kind: str = "bigint") -> str:
    """Integer division towards zero; fails by zero and for the smallest value by -1."""
    return f"CASE WHEN ({b}) = 0 OR (({a}) = {_low(kind)} AND ({b}) = -1) THEN NULL ELSE cast(({a}) div ({b}) AS {kind}) END"


def rem(a: str, b: str, kind: str = "bigint") -> str:
    """Remainder with the dividend's sign; fails as div does."""
    return f"CASE WHEN ({b}) = 0 OR (({a}) = {_low(kind)} AND ({b}) = -1) THEN NULL ELSE cast(({a}) % ({b}) AS {kind}) END"


def fdiv(a: str, b: str) -> str:
    """IEEE division: by zero gives an infinity or NaN."""
    return f"CASE WHEN ({b}) = 0D THEN CASE WHEN ({a}) > 0 THEN double('Infinity') WHEN ({a}) < 0 THEN double('-Infinity') ELSE double('NaN') END ELSE ({a}) / ({b}) END"


def shl(a: str, n: str, kind: str = "bigint") -> str:
    """Shift left; fails for amounts outside 0 .. width - 1."""
    return f"CASE WHEN ({n}) BETWEEN 0 AND {BITS[kind] - 1} THEN cast(shiftleft(({a}), cast(({n}) AS int)) AS {kind}) END"


def shr(a: str, n: str, kind: str = "bigint") -> str:
    """Arithmetic shift right; fails as shl does."""
    return f"CASE WHEN ({n}) BETWEEN 0 AND {BITS[kind] - 1} THEN cast(shiftright(({a}), cast(({n}) AS int)) AS {kind}) END"


def both(a: str, b: str) -> str:
    """a and b; fails if a does."""
    return f"CASE WHEN ({a}) THEN ({b}) WHEN NOT ({a}) THEN false END"


def either(a: str, b: str) -> str:
    """a or b; fails if a does."""
    return f"CASE WHEN ({a}) THEN true WHEN NOT ({a}) THEN ({b}) END"


def unsigned(a: str, bits: int) -> str:
    """a modulo 2^bits, for columns that hold unsigned numbers of 8, 16 or 32 bits."""
    return f"pmod(({a}), {1 << bits}L)"


def to_int(a: str, kind: str = "int") -> str:
    """A float cut off at the type's limits; NaN gives 0."""
    high = -LOW[kind] - 1
    return f"CASE WHEN isnan({a}) THEN cast(0 AS {kind}) WHEN ({a}) >= {high}D THEN cast({high}L AS {kind}) WHEN ({a}) <= {LOW[kind] + (kind == 'bigint')}D THEN cast({_low(kind)} AS {kind}) ELSE cast(({a}) AS {kind}) END"


def some(a: str) -> str:
    """An optional value that is there; `none` one that isn't. Both are structs, so neither is a failure."""
    return f"named_struct('some', true, 'value', {a})"


def none(kind: str) -> str:
    return f"named_struct('some', false, 'value', cast(NULL AS {kind}))"


def dual(a: str) -> str:
    """A value whose order is reversed: a lattice that merges duals by max keeps the smallest value. The field is `dual`."""
    return f"named_struct('dual', {a})"
