"""SMT-LIB text: s-expressions, separation-logic problems, ground string, bit-vector and array checks, string escapes."""

from __future__ import annotations

import re

from .formula import NIL, Node
from .predicates import Registry, Unsound
from .prove import decide, satisfiable_formula

TOKEN = re.compile(r""";[^\n]*|\s+|(?P<open>\()|(?P<close>\))|(?P<text>"(?:[^"]|"")*")|(?P<bar>\|[^|]*\|)|(?P<word>[^\s()";|]+)""")


class Malformed(ValueError):
    pass


def read(text: str) -> list:
    """Nested lists of words; texts keep their quotes."""
    stack: list[list] = [[]]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Malformed(f"at {text[at:at + 10]!r}")
        at = m.end()
        if m["open"]:
            stack.append([])
        elif m["close"]:
            if len(stack) == 1:
                raise Malformed("a bracket too many")
            done = stack.pop()
            stack[-1].append(done)
        elif m["text"] is not None:
            stack[-1].append(m["text"])
        elif m["bar"] is not None:
            stack[-1].append(m["bar"][1:-1])
        elif m["word"]:
            stack[-1].append(m["word"])
    if len(stack) != 1:
        raise Malformed("an open bracket")
    return stack[0]


ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")


def unescaped(quoted: str) -> str:
    """A text literal: doubled quotes, \\u{..}, \\uXXXX and \\xXX."""
    body = quoted[1:-1] if quoted[:1] == '"' else quoted
    return ESCAPE.sub(lambda m: chr(min(int(m[1] or m[2] or m[3], 16), 0x10FFFF)), body.replace('""', '"'))


class Problem:
    """A separation-logic problem: predicates, the asserted formula, and, of an entailment, what is to follow from it."""

    def __init__(self, text: str):
        self.registry = Registry()
        self.status, self.logic = "", ""
        self.left: list[Node] = []
        self.right: Node | None = None
        self.fields: dict[str, int] = {}
        self.defined: dict[str, tuple[list[str], object]] = {}
        for c in read(text):
            if not isinstance(c, list) or not c:
                continue
            word = c[0]
            if word == "set-info" and len(c) > 2 and c[1] == ":status":
                self.status = c[2]
            elif word == "set-logic":
                self.logic = c[1]
            elif word in ("define-fun-rec", "define-fun"):
                self.define(c[1], [p[0] for p in c[2]], c[4])
            elif word == "define-funs-rec":
                for head, body in zip(c[1], c[2], strict=True):
                    self.define(head[0], [p[0] for p in head[1]], body)
            elif word == "assert":
                self.asserted(c[1])

    def define(self, name: str, params: list[str], body) -> None:
        f = self.formula(body)
        self.registry.register(name, " ".join(params), "emp", validate=False)
        from .predicates import Predicate, check

        try:
            check(name, tuple(params), f)
        except Unsound:
            pass
        self.registry.known[name] = Predicate(name, tuple(params), f)

    def asserted(self, e) -> None:
        if isinstance(e, list) and e and e[0] == "not" and isinstance(e[1], list) and e[1] and e[1][0] not in ("=", "distinct") and self.left:
            self.right = self.formula(e[1]) if self.right is None else Node("or", (self.right, self.formula(e[1])))
        else:
            self.left.append(self.formula(e))

    def term(self, e):
        if isinstance(e, list):
            if e and e[0] == "as" or e and e[0] == "nil":
                return NIL
            if len(e) == 3 and e[0] in ("+", "-", "*"):
                return Node(e[0], (self.term(e[1]), self.term(e[2])))
            if len(e) == 2 and e[0] == "-":
                return Node("-", (0, self.term(e[1])))
            raise Malformed(f"term {e}")
        if re.fullmatch(r"-?\d+", e):
            return int(e)
        return NIL if e in ("nil", "null") else re.sub(r"[^A-Za-z0-9_']", "_", e.lstrip("?"))

    def formula(self, e) -> Node:
        if isinstance(e, str):
            if e in ("true", "false", "emp"):
                return Node(e)
            if e == "sep.emp":
                return Node("emp")
            raise Malformed(f"formula {e}")
        head = e[0]
        if isinstance(head, list) and head[:2] == ["_", "emp"] or e[:2] == ["_", "emp"] or head in ("emp", "sep.emp"):
            return Node("emp")
        if head in ("sep", "ssep", "tobool", "tospace"):
            parts = [self.formula(x) for x in e[1:]]
            return parts[0] if len(parts) == 1 else Node("star", tuple(parts))
        if head in ("and", "or"):
            parts = [self.formula(x) for x in e[1:]]
            return parts[0] if len(parts) == 1 else Node(head, tuple(parts))
        if head == "wand":
            return Node("wand", (self.formula(e[1]), self.formula(e[2])))
        if head == "not":
            return Node("not", (self.formula(e[1]),))
        if head in ("exists", "forall"):
            return Node(head, (tuple(self.term(v[0]) for v in e[1]), self.formula(e[2])))
        if head == "pto":
            value = e[2]
            if isinstance(value, list) and value and value[0] in ("sref",):
                cells = [self.term(x[2]) for x in value[1:]]
            elif isinstance(value, list) and value and value[0] == "ref":
                cells = [self.term(value[2])]
            elif isinstance(value, list) and value and isinstance(value[0], str) and value[0].startswith(("c_", "C_")):
                cells = [self.term(x) for x in value[1:]]
            else:
                cells = [self.term(value)]
            return Node("cell", (self.term(e[1]), *cells))
        if head == "distinct":
            terms = [self.term(x) for x in e[1:]]
            pairs = [Node("!=", (a, b)) for i, a in enumerate(terms) for b in terms[i + 1 :]]
            return pairs[0] if len(pairs) == 1 else Node("and", tuple(pairs))
        if head in ("=", "<", "<=", ">", ">="):
            return Node(head, (self.term(e[1]), self.term(e[2])))
        if head == "index":
            return self.formula(e[2])
        return Node("pred", (head, *(self.term(x) for x in e[1:])))

    def together(self) -> Node:
        spatial = [f for f in self.left]
        return spatial[0] if len(spatial) == 1 else Node("and", tuple(spatial))

    def verdict(self) -> str:
        """As the problem's status is meant: unsat for an entailment that holds or a formula without a model."""
        if not self.left:
            return "unknown"
        if self.right is not None:
            return {"valid": "unsat", "invalid": "sat"}.get(decide(self.together(), self.right, False, self.registry)[0], "unknown")
        return satisfiable_formula(self.together(), self.registry)


def run(text: str) -> tuple[str, str, str]:
    """(expected, found, error) of a problem's text."""
    try:
        p = Problem(text)
        return p.status or "unknown", p.verdict(), ""
    except (Malformed, IndexError, ValueError, RecursionError, TypeError) as e:
        return "unknown", "error", str(e)[:200] or type(e).__name__


# ground terms of other theories


def ground(e, names: dict):
    """A ground term's value: booleans, integers, texts, (bits, width) for bit vectors, (default, entries) for arrays; None if it is
    not ground or not known."""
    if isinstance(e, str):
        if e in names:
            return names[e]
        if e[:1] == '"':
            return unescaped(e)
        if re.fullmatch(r"-?\d+", e):
            return int(e)
        if e[:2] in ("#x", "#b"):
            return (int(e[2:], 16), 4 * (len(e) - 2)) if e[1] == "x" else (int(e[2:], 2), len(e) - 2)
        return {"true": True, "false": False}.get(e)
    if e[:1] == ["_"] and len(e) == 3 and e[1].startswith("bv"):
        return int(e[1][2:]) % (1 << int(e[2])), int(e[2])
    if isinstance(e[0], list):
        if e[0][:2] == ["as", "const"]:
            v = ground(e[1], names)
            return None if v is None else (v, ())
        if e[0][:1] == ["_"] and e[0][1] == "extract":
            v = ground(e[1], names)
            hi, lo = int(e[0][2]), int(e[0][3])
            return None if v is None else (v[0] >> lo & ((1 << hi - lo + 1) - 1), hi - lo + 1)
        return None
    a = [ground(x, names) for x in e[1:]]
    op = e[0]
    if op in ("and", "or"):
        if (op == "and" and False in a) or (op == "or" and True in a):
            return op == "or"
        return None if None in a else op == "and"
    if None in a:
        return None
    if op == "ite":
        return a[1] if a[0] else a[2]
    if op in ("=", "distinct"):
        return (len(set(map(repr, a))) == 1) if op == "=" else len(set(map(repr, a))) == len(a)
    if op == "not":
        return not a[0]
    if op == "=>":
        return not a[0] or a[1]
    if op == "select":
        return dict(a[0][1]).get(a[1], a[0][0])
    if op == "store":
        return a[0][0], tuple(sorted((dict(a[0][1]) | {a[1]: a[2]}).items(), key=repr))
    if op.startswith("bv"):
        return bits(op, a)
    if op == "concat":
        return (a[0][0] << a[1][1] | a[1][0], a[0][1] + a[1][1])
    if op.startswith("str."):
        return texts(op, a)
    if op in ("+", "-", "*"):
        out = a[0] if len(a) > 1 or op != "-" else -a[0]
        for x in a[1:]:
            out = out + x if op == "+" else out - x if op == "-" else out * x
        return out
    return {"<": lambda: a[0] < a[1], "<=": lambda: a[0] <= a[1], ">": lambda: a[0] > a[1], ">=": lambda: a[0] >= a[1], "div": lambda: a[0] // a[1] if a[1] > 0 else None, "mod": lambda: a[0] % abs(a[1]) if a[1] else None, "abs": lambda: abs(a[0])}.get(op, lambda: None)()


def signed(v: tuple[int, int]) -> int:
    return v[0] - (1 << v[1]) if v[0] >> v[1] - 1 else v[0]


def bits(op: str, a: list):
    """Bit-vector operators, modulo the width; division by zero gives all ones, its remainder the dividend."""
    w = a[0][1]
    full = (1 << w) - 1
    x = a[0][0]
    if op == "bvnot":
        return ~x & full, w
    if op == "bvneg":
        return -x & full, w
    y = a[1][0]
    s, t = signed(a[0]), signed(a[1])
    compare = {"bvult": x < y, "bvule": x <= y, "bvugt": x > y, "bvuge": x >= y, "bvslt": s < t, "bvsle": s <= t, "bvsgt": s > t, "bvsge": s >= t}
    if op in compare:
        return compare[op]
    quotient = (abs(s) // abs(t) * (1 if (s < 0) == (t < 0) else -1)) if t else (-1 if s >= 0 else 1)
    value = {
        "bvadd": x + y,
        "bvsub": x - y,
        "bvmul": x * y,
        "bvand": x & y,
        "bvor": x | y,
        "bvxor": x ^ y,
        "bvudiv": x // y if y else full,
        "bvurem": x % y if y else x,
        "bvsdiv": quotient,
        "bvsrem": s - t * quotient if t else s,
        "bvshl": x << y if y < w else 0,
        "bvlshr": x >> y if y < w else 0,
        "bvashr": s >> min(y, w - 1),
    }.get(op)
    return None if value is None else (value & full, w)


def texts(op: str, a: list):
    x = a[0]
    if op == "str.++":
        return "".join(a)
    if op == "str.len":
        return len(x)
    if op == "str.substr":
        return x[a[1] : a[1] + a[2]] if 0 <= a[1] < len(x) and a[2] > 0 else ""
    if op == "str.at":
        return x[a[1]] if 0 <= a[1] < len(x) else ""
    if op == "str.indexof":
        return x.find(a[1], a[2]) if 0 <= a[2] <= len(x) else -1
    if op == "str.replace":
        return x.replace(a[1], a[2], 1) if a[1] else a[2] + x
    if op == "str.replace_all":
        return x.replace(a[1], a[2]) if a[1] else x
    if op in ("str.contains", "str.prefixof", "str.suffixof"):
        return a[1] in x if op == "str.contains" else a[1].startswith(x) if op == "str.prefixof" else a[1].endswith(x)
    if op in ("str.to_int", "str.to.int"):
        return int(x) if x.isascii() and x.isdigit() else -1
    if op in ("str.<", "str.<="):
        return x < a[1] if op == "str.<" else x <= a[1]
    return None


def ground_status(text: str) -> tuple[str, str]:
    """(expected, sat, unsat or unknown) of assertions: definitions by equality are used, what is ground is computed."""
    status, names, asserts = "unknown", {}, []
    try:
        for c in read(text):
            if c[0] == "set-info" and c[1:2] == [":status"]:
                status = c[2]
            elif c[0] == "assert":
                asserts.append(c[1])
            elif c[0] == "define-fun" and not c[2]:
                names[c[1]] = ground(c[4], names)
        asserts = [x for a in asserts for x in (a[1:] if isinstance(a, list) and a[0] == "and" else [a])]
        changed = True
        while changed:
            changed = False
            for a in asserts:
                if isinstance(a, list) and a[0] == "=" and len(a) == 3:
                    for x, y in ((a[1], a[2]), (a[2], a[1])):
                        if isinstance(x, str) and x not in names and x[:1] not in '"#0123456789' and (v := ground(y, names)) is not None:
                            names[x] = v
                            changed = True
        values = [ground(a, names) for a in asserts]
    except (Malformed, IndexError, ValueError, TypeError, RecursionError):
        return status, "error"
    return status, "unsat" if False in values else "unknown" if None in values else "sat"
