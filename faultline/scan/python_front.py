"""Python programs, by the standard parser."""

from __future__ import annotations

import ast

from .ir import Expr, Func, Module, Stmt

BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.LShift: "<<", ast.RShift: ">>", ast.BitOr: "|", ast.BitAnd: "&", ast.BitXor: "^", ast.MatMult: "@"}
COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "==", ast.IsNot: "!=", ast.In: "in", ast.NotIn: "not in"}
UNARY = {ast.Not: "not", ast.USub: "-", ast.UAdd: "+", ast.Invert: "~"}


class _Reader:
    def __init__(self):
        self.functions: list[Func] = []
        #: Local names of imported modules and of what is imported from them.
        self.known: dict[str, str] = {}
        self.members: dict[str, dict[str, str]] = {}

    def expr(self, n: ast.AST | None) -> Expr:
        if n is None:
            return Expr("const")
        line = getattr(n, "lineno", 0)
        e = self.expr
        match n:
            case ast.Name():
                full = self.known.get(n.id)
                if full and "." in full:
                    out = Expr("name", full.split(".")[0], (), line)
                    for part in full.split(".")[1:]:
                        out = Expr("attr", part, (out,), line)
                    return out
                return Expr("name", full or n.id, (), line)
            case ast.Constant():
                return Expr("const", "", (), line, n.value.decode("latin-1") if isinstance(n.value, bytes) else n.value)
            case ast.Attribute():
                return Expr("attr", n.attr, (e(n.value),), line)
            case ast.Subscript():
                return Expr("index", "", (e(n.value), e(n.slice)), line)
            case ast.Call():
                named = [Expr("kw", k.arg or "**", (e(k.value),), line) for k in n.keywords]
                return Expr("call", "", (e(n.func), *map(e, n.args), *named), line)
            case ast.BinOp():
                return Expr("op", BINARY[type(n.op)], (e(n.left), e(n.right)), line)
            case ast.UnaryOp():
                inner = e(n.operand)
                if isinstance(n.op, ast.USub) and inner.kind == "const" and isinstance(inner.value, int):
                    return Expr("const", "", (), line, -inner.value)
                return Expr("op", UNARY[type(n.op)], (inner,), line)
            case ast.BoolOp():
                word = "and" if isinstance(n.op, ast.And) else "or"
                out = e(n.values[0])
                for v in n.values[1:]:
                    out = Expr("op", word, (out, e(v)), line)
                return out
            case ast.Compare():
                parts, left = [], n.left
                for op, right in zip(n.ops, n.comparators, strict=True):
                    parts.append(Expr("op", COMPARE[type(op)], (e(left), e(right)), line))
                    left = right
                out = parts[0]
                for p in parts[1:]:
                    out = Expr("op", "and", (out, p), line)
                return out
            case ast.IfExp():
                return Expr("cond", "", (e(n.test), e(n.body), e(n.orelse)), line)
            case ast.JoinedStr():
                return Expr("fmt", "", tuple(e(v.value if isinstance(v, ast.FormattedValue) else v) for v in n.values), line)
            case ast.Tuple() | ast.List() | ast.Set():
                return Expr("seq", "list", tuple(map(e, n.elts)), line)
            case ast.Dict():
                return Expr("seq", "dict", tuple(Expr("kw", k.value if isinstance(k, ast.Constant) and isinstance(k.value, str) else "*", (e(v),), line) for k, v in zip(n.keys, n.values, strict=True)), line)
            case ast.Lambda():
                return Expr("lambda", "", (e(n.body),), line)
            case ast.Await() | ast.Starred() | ast.FormattedValue() | ast.YieldFrom():
                return e(n.value)
            case ast.Yield():
                return e(n.value)
            case ast.NamedExpr():
                return e(n.value)
            case ast.Slice():
                return Expr("op", ":", tuple(e(x) for x in (n.lower, n.upper, n.step) if x is not None), line)
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp():
                return Expr("seq", "each", (e(n.elt), *(e(g.iter) for g in n.generators)), line)
            case ast.DictComp():
                return Expr("seq", "each", (e(n.value), *(e(g.iter) for g in n.generators)), line)
        return Expr("const", "", (), line)

    def block(self, body: list[ast.stmt], owner: str) -> list[Stmt]:
        return [s for n in body for s in self.stmt(n, owner)]

    def stmt(self, n: ast.stmt, owner: str) -> list[Stmt]:
        line = n.lineno
        e = self.expr
        match n:
            case ast.Assign():
                return [Stmt("assign", line, e(t), e(n.value)) for t in n.targets]
            case ast.AnnAssign():
                return [Stmt("assign", line, e(n.target), e(n.value))] if n.value else []
            case ast.AugAssign():
                return [Stmt("assign", line, e(n.target), e(n.value), BINARY[type(n.op)])]
            case ast.Expr():
                return [Stmt("expr", line, value=e(n.value))]
            case ast.Return():
                return [Stmt("return", line, value=e(n.value) if n.value else None)]
            case ast.If():
                return [Stmt("if", line, value=e(n.test), body=self.block(n.body, owner), orelse=self.block(n.orelse, owner))]
            case ast.While():
                return [Stmt("loop", line, value=e(n.test), body=self.block(n.body, owner), orelse=self.block(n.orelse, owner), type="while")]
            case ast.For() | ast.AsyncFor():
                return [Stmt("loop", line, target=e(n.target), value=e(n.iter), body=self.block(n.body, owner), orelse=self.block(n.orelse, owner), type="each")]
            case ast.With() | ast.AsyncWith():
                out = []
                for item in n.items:
                    value = e(item.context_expr)
                    out.append(Stmt("assign", line, e(item.optional_vars), value) if item.optional_vars else Stmt("expr", line, value=value))
                return [*out, *self.block(n.body, owner)]
            case ast.Try() | ast.TryStar():
                handlers = [(h.name or "", self.block(h.body, owner)) for h in n.handlers]
                return [Stmt("try", line, body=self.block(n.body, owner), parts=handlers, orelse=self.block(n.orelse, owner), final=self.block(n.finalbody, owner))]
            case ast.Raise():
                return [Stmt("throw", line, value=e(n.exc) if n.exc else None)]
            case ast.Break():
                return [Stmt("break", line)]
            case ast.Continue():
                return [Stmt("continue", line)]
            case ast.Assert():
                return [Stmt("if", line, value=e(n.test), orelse=[Stmt("throw", line)])]
            case ast.Delete():
                return [Stmt("expr", line, value=Expr("call", "", (Expr("name", "del", (), line), *map(e, n.targets)), line))]
            case ast.Match():
                cases = []
                for c in n.cases:
                    wild = isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None
                    cases.append((None if wild else Expr("const"), [*self.block(c.body, owner), Stmt("break", line)]))
                return [Stmt("switch", line, value=e(n.subject), parts=cases)]
            case ast.Import():
                for a in n.names:
                    if a.asname:
                        self.known[a.asname] = a.name
                return []
            case ast.ImportFrom():
                for a in n.names:
                    if n.module and not n.level:
                        self.known[a.asname or a.name] = f"{n.module}.{a.name}"
                return []
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                a = n.args
                params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                f = Func(n.name, params, [], line, owner, tuple(ast.unparse(d) for d in n.decorator_list))
                f.types = {x.arg: ast.unparse(x.annotation) for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.annotation}
                self.functions.append(f)
                f.body = self.block(n.body, "")
                return [Stmt("func", line, func=f)]
            case ast.ClassDef():
                self.members.setdefault(n.name, {})
                return [Stmt("class", line, body=self.block(n.body, n.name), type=n.name)]
        return []


def read(text: str) -> Module:
    try:
        tree = ast.parse(text)
        r = _Reader()
        return Module("python", r.block(tree.body, ""), r.functions, r.members)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return Module("python", [], [], error=str(problem)[:200] or type(problem).__name__, error_line=getattr(problem, "lineno", None))
