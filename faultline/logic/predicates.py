"""Inductive predicates as rows of text, checked before they are used; users add their own."""

from __future__ import annotations

from dataclasses import dataclass

from .formula import Node, parse

#: Name, parameters and definition of the predicates that are known from the start.
DEFINITIONS = (
    ("ls", "x y", "x = y & emp | (exists z. x != y & x |-> z * ls(z, y))"),
    ("list", "x", "x = nil & emp | (exists z. x |-> z * list(z))"),
    ("tree", "x", "x = nil & emp | (exists l r. x |-> (l, r) * tree(l) * tree(r))"),
    ("dll", "f b p n", "f = n & b = p & emp | (exists u. f != n & b != p & f |-> (u, p) * dll(u, b, f, n))"),
    ("RList", "x y", "x = y & emp | (exists z. x |-> z * RList(z, y))"),
    ("nll", "x y z", "x = y & emp | (exists n. x |-> (n, z) * nll(n, y, z))"),
    ("skl1", "x y", "x = y & emp | (exists z. x |-> z * skl1(z, y))"),
    ("skl2", "x y", "x = y & emp | (exists a b. x |-> (a, b) * skl2(b, y))"),
    ("skl3", "x y", "x = y & emp | (exists a b c. x |-> (a, b, c) * skl3(c, y))"),
    ("sls", "x low y high", "x = y & emp | (exists v z. low <= v & v <= high & x |-> (v, z) * sls(z, v, y, high))"),
    ("lsso", "x y", "x = y & emp | (exists u. x |-> (u, u) * lsso(u, y))"),
)


class Unsound(ValueError):
    pass


@dataclass(frozen=True)
class Predicate:
    name: str
    params: tuple[str, ...]
    body: Node


def parts_of(f: Node) -> list[Node]:
    """Conjuncts under separating and plain conjunction."""
    if f.op in ("star", "and"):
        return [x for a in f.args for x in parts_of(a)]
    return [f]


def disjuncts(f: Node) -> list[Node]:
    return [x for a in f.args for x in disjuncts(a)] if f.op == "or" else [f]


def opened(f: Node) -> tuple[list[str], Node]:
    """Leading existential names, and what they range over."""
    names: list[str] = []
    while f.op == "exists":
        names += f.args[0]
        f = f.args[1]
    return names, f


def check(name: str, params: tuple[str, ...], body: Node) -> None:
    """A definition is accepted if it has a case without recursion, every recursive case allocates a cell at its first parameter,
    and its names are parameters, existential or nil: then unfolding makes progress and each heap has finitely many derivations."""
    base = False
    for case in disjuncts(body):
        names, inner = opened(case)
        parts = parts_of(inner)
        inductive = [p for p in parts if p.op == "pred"]
        cells = [p for p in parts if p.op == "cell"]
        base |= not any(p.args[0] == name for p in inductive)
        if any(p.args[0] == name for p in inductive) and not any(c.args[0] == params[0] for c in cells):
            raise Unsound(f"{name}: a recursive case must allocate {params[0]}")
        for p in inductive:
            if p.args[0] == name and len(p.args) - 1 != len(params):
                raise Unsound(f"{name}: takes {len(params)} arguments")
        for p in parts:
            if p.op not in ("pred", "cell", "emp", "true", "=", "!=", "<", "<=", ">", ">="):
                raise Unsound(f"{name}: {p.op} in a definition")
            used = {a for a in _names(p) if a != "nil"}
            if p.op in ("cell", "pred", "=", "!=") and not used <= {*params, *names}:
                raise Unsound(f"{name}: unknown names {sorted(used - {*params, *names})}")
    if not base:
        raise Unsound(f"{name}: no case without recursion")


def _names(f) -> set[str]:
    if isinstance(f, str):
        return {f}
    if isinstance(f, Node):
        own = f.args[1:] if f.op == "pred" else f.args
        return {x for a in own for x in _names(a)}
    return set()


class Registry:
    def __init__(self, rows=DEFINITIONS):
        self.known: dict[str, Predicate] = {}
        for name, params, text in rows:
            self.register(name, params, text)

    def register(self, name: str, params: str, text: str, validate: bool = True) -> None:
        words, body = tuple(params.split()), parse(text)
        if validate:
            check(name, words, body)
        self.known[name] = Predicate(name, words, body)

    def get(self, name: str, arity: int) -> Predicate | None:
        p = self.known.get(name)
        return p if p and len(p.params) == arity else None


STANDARD = Registry()
