"""Patterns that take values apart inside rules, as Python objects over SQL text.

A pattern says what an expression must be and which variables it binds: `matching("x", some("v"))` keeps rows whose x
is there and binds v. Alternatives are tried in order, and the first that matches binds.
"""

from __future__ import annotations

from dataclasses import dataclass

from quillon.plans.engine import Atom, Let, Where, atom


@dataclass(frozen=True)
class Pattern:
    test: str  # SQL over {0}, the value
    binds: tuple[tuple[str, str], ...] = ()  # variable, SQL over {0}


def _of(p: Pattern | str | object) -> Pattern:
    """A name binds, `_` takes anything, any other text or value must be equal."""
    if isinstance(p, Pattern):
        return p
    if p == "_":
        return Pattern("true")
    if isinstance(p, str) and p.isidentifier() and p not in ("true", "false"):
        return Pattern("true", ((p, "{0}"),))
    return Pattern("{0} = (" + str(p).replace("{", "{{").replace("}", "}}") + ")")


def _inside(p: Pattern, place: str) -> Pattern:
    return Pattern(p.test.replace("{0}", place), tuple((v, e.replace("{0}", place)) for v, e in p.binds))


def _all(test: str, *parts: Pattern) -> Pattern:
    tests = [t for t in (test, *(p.test for p in parts)) if t != "true"]
    return Pattern(" AND ".join(f"({t})" for t in tests) or "true", tuple(b for p in parts for b in p.binds))


def bound(name: str, sub: object) -> Pattern:
    """The whole value as name, if sub matches it."""
    return _all("true", Pattern("true", ((name, "{0}"),)), _of(sub))


def some(sub: object) -> Pattern:
    return _all("{0}.some", _inside(_of(sub), "{0}.value"))


def none() -> Pattern:
    return Pattern("NOT {0}.some")


def dual(sub: object) -> Pattern:
    return _inside(_of(sub), "{0}.dual")


def of_type(**fields: object) -> Pattern:
    """A struct, by patterns of its fields; others may be anything."""
    return _all("true", *[_inside(_of(p), f"{{0}}.`{n}`") for n, p in fields.items()])


def one_of(*options: object) -> Pattern:
    """The first that matches; all bind the same variables."""
    each = [_of(p) for p in options]
    names = [v for v, _ in each[0].binds]
    if any(sorted(v for v, _ in p.binds) != sorted(names) for p in each):
        raise ValueError("alternatives bind different variables")
    binds = tuple((v, "CASE " + " ".join(f"WHEN {p.test} THEN {dict(p.binds)[v]}" for p in each) + " END") for v in names)
    return Pattern(" OR ".join(f"({p.test})" for p in each), binds)


def matching(expression: str, pattern: object) -> tuple[Where | Let, ...]:
    """Body items: rows where the expression matches, with the pattern's variables. A let that can fail, or an if-let."""
    p = _inside(_of(pattern), f"({expression})")
    fill = lambda t: t.replace("{{", "{").replace("}}", "}")
    return tuple([Where(fill(p.test))] * (p.test != "true") + [Let(v, fill(e)) for v, e in p.binds])


def matched_atom(name: str, *terms: object) -> tuple[Atom | Where | Let, ...]:
    """An atom some of whose terms are patterns."""
    after: list = []
    plain = []
    for k, t in enumerate(terms):
        plain.append(f"part{k}of{name}" if isinstance(t, Pattern) else t)
        if isinstance(t, Pattern):
            after += matching(plain[-1], t)
    return (atom(name, *plain), *after)
