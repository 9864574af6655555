"""C, C++, Java, C# and JavaScript (TypeScript, JSX) programs, by one tolerant parser for languages with braces.

Statements and expressions are parsed in full; declarations by shape. What does not parse is skipped up to the next semicolon or
brace, so a file always gives what could be read of it; findings over it are lexical where types would be needed.
"""

from __future__ import annotations

import re

from .ir import Expr, Func, Module, Stmt

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pp>^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)
      |(?P<str>(?:\b(?:u8|[LuUR]))?@?\$?"(?:[^"\\\n]|\\.)*"|(?:\bL)?'(?:[^'\\\n]|\\.)*')
      |(?P<num>0[xX][0-9a-fA-F_]+[uUlLn]*|0[bB][01_]+[uUlL]*|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[uUlLfFdDmMn]*)
      |(?P<name>[A-Za-z_$@][\w$]*)
      |(?P<op>>>>=|\.\.\.|<<=|>>=|===|!==|\*\*=|&&=|\|\|=|\?\?=|>>>|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|=>|\?\.|\?\?|\*\*|[-+*/%&|^~!<>=?:;,.()\[\]{}#\\])
      |(?P<other>.)""",
    re.X | re.S | re.M,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
LEVELS = [("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in", "is", "as"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",)]
RANK = {op: i for i, ops in enumerate(LEVELS) for op in ops}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())
WORDS = frozenset("if else for while do switch case default return break continue throw try catch finally new delete function class struct union enum namespace using import export package typedef goto foreach in of instanceof typeof sizeof var let const static public private protected internal final abstract override virtual async await yield interface extends implements void int char long short float double bool boolean unsigned signed string String auto register volatile extern inline this null nullptr NULL true false undefined synchronized lock fixed checked unchecked unsafe throws".split())
PLAIN_TYPES = frozenset("void int char long short float double bool boolean unsigned signed string auto size_t ssize_t wchar_t byte sbyte uint ulong ushort object decimal var let const dynamic FILE int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char16_t".split())
MODIFIERS = frozenset("static public private protected internal final abstract override virtual async extern inline volatile register const constexpr unsafe readonly sealed partial synchronized native transient export default declare explicit friend mutable struct enum union typename required init".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


#: What can follow a class's name where the class is defined.
CLASS_HEADS = frozenset("{ : extends implements < final permits (".split())


class Problem(Exception):
    pass


def text_of(raw: str) -> str:
    """A quoted literal's text."""
    start = min(i for i in (raw.find('"'), raw.find("'"), raw.find("`")) if i >= 0)
    body = raw[start + 1 : -1]
    if "@" in raw[:start]:
        return body.replace('""', '"')
    return re.sub(r"\\(x[0-9a-fA-F]{1,2}|u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "xu" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), body, flags=re.S)


def integer(raw: str) -> int | float | None:
    """A C-family numeric literal: decimal, octal, hexadecimal or binary, with its suffix."""
    body = raw.replace("_", "")
    if re.fullmatch(r"0[xX][0-9a-fA-F]+[uUlLn]*", body):
        return int(re.match(r"0[xX]([0-9a-fA-F]+)", body)[1], 16)
    if re.fullmatch(r"0[bB][01]+[uUlL]*", body):
        return int(re.match(r"0[bB]([01]+)", body)[1], 2)
    if re.fullmatch(r"[0-9]+[uUlLn]*", body):
        digits = re.match(r"[0-9]+", body)[0]
        return int(digits, 8) if len(digits) > 1 and digits[0] == "0" and not re.search("[89]", digits) else int(digits)
    try:
        return float(body.rstrip("fFdDmMlL"))
    except ValueError:
        return None


class Token:
    __slots__ = ("kind", "line", "parts", "text")

    def __init__(self, kind, text, line, parts=None):
        self.kind, self.text, self.line, self.parts = kind, text, line, parts


def tokens(text: str, script: bool, line: int = 1) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        if script and text[at] == "`":
            end, parts, raw, depth = at + 1, [], "", 0
            while end < len(text) and text[end] != "`":
                if text[end] == "\\":
                    raw += text[end : end + 2]
                    end += 2
                elif text.startswith("${", end):
                    stop, depth = end + 2, 1
                    while stop < len(text) and depth:
                        depth += {"{": 1, "}": -1}.get(text[stop], 0)
                        stop += 1
                    parts.append(text[end + 2 : stop - 1])
                    raw += "${}"
                    end = stop
                else:
                    raw += text[end]
                    end += 1
            out.append(Token("fmt", raw, line, [tokens(p, True, line) for p in parts]))
            line += text.count("\n", at, end + 1)
            at = end + 1
            continue
        if script and text[at] == "/" and (not out or out[-1].kind == "op" and out[-1].text not in (")", "]", "}") or out[-1].text in ("return", "typeof", "case")):
            m = REGEX.match(text, at)
            if m:
                out.append(Token("regex", m[0], line))
                at = m.end()
                continue
        m = TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "str" and "$" in m[0][:3] and not script:
            holes = re.findall(r"(?<!\{)\{([^{}:]+)(?::[^{}]*)?\}", m[0])
            out.append(Token("fmt", m[0], line, [tokens(h, False, line) for h in holes]))
        elif kind not in ("space", "comment", "pp", "other"):
            out.append(Token(kind, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


class Parser:
    def __init__(self, toks: list[Token], language: str):
        self.t, self.i, self.language = toks, 0, language
        self.functions: list[Func] = []
        self.members: dict[str, dict[str, str]] = {}
        self.script = language in ("javascript", "typescript")
        self.c = language in ("c", "cpp")

    def peek(self, n: int = 0) -> str:
        return self.t[self.i + n].text if self.i + n < len(self.t) and self.t[self.i + n].kind not in ("str", "fmt", "regex") else ""

    def kind(self, n: int = 0) -> str:
        return self.t[self.i + n].kind if self.i + n < len(self.t) else ""

    @property
    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)].line if self.t else 0

    def take(self, text: str | None = None) -> Token:
        if self.i >= len(self.t) or text is not None and self.peek() != text:
            raise Problem(f"line {self.line}: expected {text}")
        self.i += 1
        return self.t[self.i - 1]

    def have(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def skip(self, opener: str, closer: str) -> None:
        """Past a balanced group whose opener comes next."""
        depth = 0
        while self.i < len(self.t):
            depth += (self.peek() == opener) - (self.peek() == closer)
            self.i += 1
            if not depth:
                return

    # expressions

    def expr(self) -> Expr:
        e = self.assignment()
        while self.peek() == ",":
            line = self.take().line
            e = Expr("seq", "comma", (e, self.assignment()), line)
        return e

    def assignment(self) -> Expr:
        if (arrow := self.arrow()) is not None:
            return arrow
        left = self.ternary()
        if self.peek() in ASSIGN:
            op = self.take()
            return Expr("op", op.text, (left, self.assignment()), op.line)
        return left

    def arrow(self) -> Expr | None:
        """x => .., (a, b) => .. or async forms of them; also lambdas of Java (->)."""
        j = self.i + (self.peek() == "async")
        line = self.line
        mark = "=>" if self.language != "java" else "->"
        if self.c or j >= len(self.t):
            return None
        if self.t[j].kind == "name" and j + 1 < len(self.t) and self.t[j + 1].text == mark and self.t[j + 1].kind == "op":
            params, stop = [self.t[j].text], j + 2
        elif self.t[j].text == "(" and self.t[j].kind == "op":
            depth, stop = 0, j
            while stop < len(self.t):
                if self.t[stop].kind == "op":
                    depth += (self.t[stop].text in "([{") - (self.t[stop].text in ")]}") if len(self.t[stop].text) == 1 else 0
                stop += 1
                if not depth:
                    break
            while stop < len(self.t) and self.script and self.t[stop].text == ":" and stop + 1 < len(self.t) and self.t[stop + 1].kind == "name":
                stop += 2
            if stop >= len(self.t) or self.t[stop].text != mark or self.t[stop].kind != "op":
                return None
            params = parameter_names(self.t[j + 1 : stop - 1])
            stop += 1
        else:
            return None
        self.i = stop
        f = Func("", params, [], line)
        self.functions.append(f)
        f.body = self.braces() if self.peek() == "{" else [Stmt("return", line, value=self.assignment())]
        return Expr("lambda", f"{len(self.functions) - 1}", (), line, f)

    def ternary(self) -> Expr:
        e = self.binary(0)
        if self.peek() == "?":
            line = self.take().line
            yes = self.assignment()
            self.take(":")
            return Expr("cond", "", (e, yes, self.assignment()), line)
        return e

    def binary(self, level: int) -> Expr:
        left = self.unary()
        while (rank := RANK.get(self.peek(), -1)) >= level:
            op = self.take()
            if op.text in ("as", "is", "instanceof") and not self.script:
                kind = self.type_name() or "?"
                if self.kind() == "name" and self.peek() not in WORDS and op.text != "as":
                    self.take()
                left = Expr("cast" if op.text == "as" else "op", kind if op.text == "as" else op.text, (left,), op.line)
                continue
            if op.text == "as":
                self.type_name()
                continue
            left = Expr("op", op.text, (left, self.binary(rank + 1)), op.line)
        return left

    def unary(self) -> Expr:
        line, p = self.line, self.peek()
        if self.kind() == "op":
            if p in ("!", "-", "+", "~", "++", "--"):
                self.take()
                e = self.unary()
                if p == "-" and e.kind == "const" and isinstance(e.value, (int, float)):
                    return Expr("const", "", (), line, -e.value)
                return Expr("op", p + "pre" if len(p) == 2 else p, (e,), line)
            if p in ("*", "&", "&&") and self.c:
                self.take()
                return Expr("deref" if p == "*" else "addr", "", (self.unary(),), line)
            if p == "...":
                self.take()
                return self.unary()
            if p == "(":
                if (cast := self.cast()) is not None:
                    return cast
        elif p in ("typeof", "await", "void", "yield", "throw") and self.kind() == "name" and (p != "void" or self.script):
            self.take()
            return self.unary()
        elif p == "delete" and self.kind() == "name":
            self.take()
            array = self.peek() == "[" and self.peek(1) == "]"
            if array:
                self.i += 2
            return Expr("call", "", (Expr("name", "delete[]" if array else "delete", (), line), self.unary()), line)
        elif p == "sizeof":
            self.take()
            if self.peek() == "(":
                start = self.i + 1
                self.skip("(", ")")
                inside = [t.text for t in self.t[start : self.i - 1]]
                return Expr("op", "sizeof", (Expr("name", inside[0], (), line),) if len(inside) == 1 else (), line, " ".join(inside))
            return Expr("op", "sizeof", (self.unary(),), line)
        return self.postfix(self.primary())

    def cast(self) -> Expr | None:
        """(type) expression; None if the bracket holds an expression."""
        start, line = self.i, self.line
        if self.script:
            return None
        self.take("(")
        kind = self.type_name()
        if kind and self.peek() == ")" and (self.plain(kind) or kind.endswith("*") or kind[0].isupper() or kind.startswith("struct ")):
            self.take(")")
            nxt = self.peek()
            if self.kind() in ("name", "num", "str", "fmt") and nxt not in RANK or nxt == "(" or nxt in ("*", "&", "-", "~", "!") and (self.plain(kind) or kind.endswith("*")):
                return Expr("cast", kind, (self.unary(),), line)
        self.i = start
        return None

    @staticmethod
    def plain(kind: str) -> bool:
        return kind.split()[0].rstrip("*") in PLAIN_TYPES

    def type_name(self) -> str:
        """A type by shape: qualified name, type arguments, pointers, array brackets; empty if none is there."""
        words: list[str] = []
        while self.peek() in MODIFIERS or self.peek() in ("unsigned", "signed"):
            words.append(self.take().text)
        if self.kind() != "name" or self.peek() in WORDS and self.peek() not in PLAIN_TYPES and self.peek() != "String":
            return " ".join(w for w in words if w in ("unsigned", "signed"))
        name = self.take().text
        while self.peek() in ("long", "int", "char", "short", "double") and name in ("unsigned", "signed", "long", "short"):
            name = f"{name} {self.take().text}"
        while self.peek() in (".", "::") and self.kind(1) == "name":
            name += self.take().text + self.take().text
        if self.peek() == "<":
            depth, j = 0, self.i
            while j < len(self.t):
                x = self.t[j].text
                depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(x, 0)
                if self.t[j].kind not in ("name", "op", "num") or x in (";", "{", "}", "(", ")", "&&", "||", "=") or depth < 0:
                    return name
                j += 1
                if depth <= 0:
                    break
            else:
                return name
            name += "".join(t.text for t in self.t[self.i : j])
            self.i = j
        while self.peek() in ("*", "&", "const", "?") or self.peek() == "[" and self.peek(1) in ("]", ","):
            if self.peek() == "[":
                while self.peek() != "]":
                    self.take()
                name += "["
            name += self.take().text
        prefix = " ".join(w for w in words if w in ("unsigned", "signed", "struct") or w == "static" and self.c)
        return f"{prefix} {name}".strip()

    def primary(self) -> Expr:
        if self.i >= len(self.t):
            raise Problem("end of text")
        tok = self.t[self.i]
        line = tok.line
        if tok.kind == "str":
            self.i += 1
            value = text_of(tok.text)
            while self.c and self.kind() == "str":
                value += text_of(self.take().text)
            if self.c and tok.text.lstrip("L").startswith("'") or self.language in ("java", "csharp") and tok.text.startswith("'"):
                return Expr("const", "char", (), line, ord(value) if len(value) == 1 else 0)
            return Expr("const", "", (), line, value)
        if tok.kind == "num":
            self.i += 1
            return Expr("const", "", (), line, integer(tok.text))
        if tok.kind == "regex":
            self.i += 1
            return Expr("const", "regex", (), line, tok.text[1 : tok.text.rindex("/")])
        if tok.kind == "fmt":
            self.i += 1
            kids = []
            for inner in tok.parts:
                p = Parser(inner, self.language)
                try:
                    kids.append(p.expr())
                except Problem:
                    pass
            return Expr("fmt", tok.text, tuple(kids), line)
        if tok.kind == "name":
            return self.word()
        if tok.text == "(":
            self.take()
            e = self.expr()
            self.take(")")
            return e
        if tok.text == "[":
            return Expr("seq", "list", tuple(self.listed("[", "]")), line)
        if tok.text == "{":
            return self.literal()
        if tok.text == "<" and self.script:
            return self.markup()
        raise Problem(f"line {line}: {tok.text!r}")

    def word(self) -> Expr:
        tok = self.take()
        line, p = tok.line, tok.text
        if p in ("true", "false", "null", "nullptr", "NULL", "undefined"):
            return Expr("const", p, (), line, {"true": True, "false": False}.get(p))
        if p == "new":
            kind = self.type_name() or (self.take().text if self.kind() == "name" else "")
            callee = Expr("name", kind.split("<")[0].rstrip("[]*"), (), line)
            args: list[Expr] = []
            if self.peek() == "(":
                args = self.listed("(", ")")
                if self.peek() == "{":
                    self.body_of_class("") if self.language == "java" else self.literal()
            elif self.peek() == "[":
                self.take()
                args = [] if self.peek() == "]" else [self.expr()]
                self.take("]")
                return Expr("new", "[]", (callee, *args), line)
            if self.peek() == "{":
                return Expr("new", "[]" if kind.endswith("]") else "", (callee, *args, self.literal()), line)
            return Expr("new", "[]" if kind.endswith("]") else "", (callee, *args), line)
        if p == "function" and self.script:
            self.have("*")
            name = self.take().text if self.kind() == "name" else ""
            f = self.function(name, line)
            return Expr("lambda", name, (), line, f)
        if p == "class" and self.script:
            if self.kind() == "name" and self.peek() != "extends":
                self.take()
            while self.peek() != "{":
                self.take()
            self.body_of_class("")
            return Expr("const", "", (), line)
        if p == "async" and self.peek() == "function":
            return self.word()
        if p in WORDS and p not in PLAIN_TYPES and p not in ("this", "in", "of", "final", "default", "string", "String", "static", "async", "await", "register", "internal", "lock", "fixed", "override", "interface", "export", "package", "using", "yield", "is"):
            raise Problem(f"line {line}: {p!r}")
        name = p.lstrip("@")
        while self.peek() == "::" and self.kind(1) == "name":
            name += self.take().text + self.take().text
        return Expr("name", name, (), line)

    def listed(self, opener: str, closer: str) -> list[Expr]:
        self.take(opener)
        out: list[Expr] = []
        while self.peek() != closer:
            if self.have(","):
                continue
            if self.kind() == "name" and self.peek(1) == ":" and not self.script:
                name = self.take().text
                self.take(":")
                out.append(Expr("kw", name, (self.assignment(),), self.line))
                continue
            if self.language == "csharp" and self.peek() in ("out", "ref") and self.kind(1) == "name":
                self.take()
                if self.kind(1) == "name":
                    self.take()
            out.append(self.assignment())
            if self.peek() != closer:
                self.take(",")
        self.take(closer)
        return out

    def literal(self) -> Expr:
        """An object, or an initialiser list."""
        line = self.take("{").line
        kids: list[Expr] = []
        while self.peek() != "}":
            if self.have(","):
                continue
            if self.have("..."):
                kids.append(self.assignment())
                continue
            if self.peek() in ("get", "set", "async") and self.kind(1) in ("name", "str") and self.script:
                self.take()
            if self.peek() == "." and self.kind(1) == "name":
                self.take()
            if self.kind() in ("name", "str", "num") and self.t[self.i + 1].text in (":", "=") and self.kind(1) == "op":
                key = self.take()
                self.take()
                kids.append(Expr("kw", text_of(key.text) if key.kind == "str" else key.text, (self.assignment(),), line))
            elif self.kind() == "name" and self.peek(1) == "(" and self.script:
                start = self.i
                name = self.take().text
                self.skip("(", ")")
                method = self.peek() == "{"
                self.i = start
                if method:
                    self.take()
                    kids.append(Expr("kw", name, (Expr("lambda", name, (), line, self.function(name, line)),), line))
                else:
                    kids.append(self.assignment())
            elif self.peek() == "[" and self.script:
                self.take()
                key = self.assignment()
                self.take("]")
                if self.have(":"):
                    kids.append(Expr("kw", "*", (self.assignment(),), line))
                else:
                    kids.append(key)
            elif self.script and self.kind() == "name" and self.peek(1) in (",", "}"):
                name = self.take().text
                kids.append(Expr("kw", name, (Expr("name", name, (), line),), line))
            elif self.peek() == "{":
                kids.append(self.literal())
            else:
                kids.append(self.assignment())
            if self.peek() != "}":
                self.take(",")
        self.take("}")
        return Expr("seq", "dict" if any(k.kind == "kw" for k in kids) else "list", tuple(kids), line)

    def markup(self) -> Expr:
        """A JSX element: its attributes as named arguments of a call, its embedded expressions as further ones."""
        line = self.take("<").line
        tag = ""
        while self.kind() == "name" or self.peek() in (".", "-", ":"):
            tag += self.take().text
            if self.kind() == "name" and self.peek(-1) not in (".", "-", ":"):
                break
        kids: list[Expr] = []
        while self.peek() not in (">", "/"):
            if self.peek() == "{":
                self.take()
                kids.append(self.expr())
                self.take("}")
                continue
            name = self.take().text
            while self.peek() == "-":
                name += self.take().text + self.take().text
            value = Expr("const", "", (), line, True)
            if self.have("="):
                if self.peek() == "{":
                    self.take()
                    value = self.expr()
                    self.take("}")
                else:
                    value = self.primary()
            kids.append(Expr("kw", name, (value,), line))
        if self.have("/"):
            self.take(">")
        else:
            self.take(">")
            while not (self.peek() == "<" and self.peek(1) == "/"):
                if self.peek() == "{":
                    self.take()
                    if self.peek() != "}":
                        kids.append(self.expr())
                    self.take("}")
                elif self.peek() == "<":
                    kids.append(self.markup())
                else:
                    self.take()
            while self.take().text != ">":
                pass
        return Expr("call", "markup", (Expr("name", f"<{tag}>", (), line), *kids), line)

    def postfix(self, e: Expr) -> Expr:
        while self.i < len(self.t):
            line, p = self.line, self.peek()
            if self.kind() != "op":
                if self.kind() == "fmt" and self.script and e.kind in ("name", "attr"):
                    e = Expr("call", "", (e, self.primary()), line)
                    continue
                return e
            if p in (".", "?.", "->") and self.kind(1) == "name":
                if p == "->" and not self.c:
                    return e
                self.take()
                field = self.take().text
                if self.peek() == "::":
                    self.take()
                    field += "::" + self.take().text
                e = Expr("attr", field, (e,) if p != "->" else (Expr("deref", "", (e,), line),), line)
            elif p == "?." and self.peek(1) in ("(", "["):
                self.take()
            elif p == "::" and self.kind(1) == "name":
                self.take()
                e = Expr("attr", self.take().text, (e,), line)
            elif p == "(":
                e = Expr("call", "", (e, *self.listed("(", ")")), line)
            elif p == "[":
                self.take()
                index = self.expr()
                self.take("]")
                e = Expr("index", "", (e, index), line)
            elif p in ("++", "--"):
                self.take()
                e = Expr("op", p + "post", (e,), line)
            elif p == "!" and self.script and self.peek(1) in (".", ")", ";", ",", "["):
                self.take()
            elif p == "!" and self.language == "csharp" and self.peek(1) in (".", ")", ";", ","):
                self.take()
            elif p == "<" and e.kind in ("name", "attr") and not self.c and (end := self.type_arguments()) is not None:
                self.i = end
            else:
                return e
        return e

    def type_arguments(self) -> int | None:
        """Where type arguments end, if a call follows them."""
        depth, j = 0, self.i
        while j < len(self.t) and j < self.i + 30:
            x = self.t[j].text
            depth += {"<": 1, ">": -1, ">>": -2}.get(x, 0)
            if self.t[j].kind not in ("name", "op") or x not in ("<", ">", ">>", ",", ".", "?", "[", "]") and self.t[j].kind == "op":
                return None
            j += 1
            if depth <= 0:
                return j if j < len(self.t) and self.t[j].text == "(" else None
        return None

    # statements

    def braces(self) -> list[Stmt]:
        self.take("{")
        out: list[Stmt] = []
        while self.i < len(self.t) and self.peek() != "}":
            out += self.statement()
        self.have("}")
        return out

    def nested(self) -> list[Stmt]:
        return self.braces() if self.peek() == "{" else self.statement()

    def statement(self) -> list[Stmt]:
        start = self.i
        try:
            return self._statement()
        except Problem:
            # past the next semicolon or balanced braces
            self.i = max(start + 1, self.i)
            while self.i < len(self.t):
                if self.peek() == ";":
                    self.i += 1
                    break
                if self.peek() == "}":
                    break
                if self.peek() == "{":
                    self.skip("{", "}")
                    break
                self.i += 1
            return []

    def _statement(self) -> list[Stmt]:
        line, p = self.line, self.peek()
        if p == ";":
            self.take()
            return []
        if p == "{":
            return [Stmt("block", line, body=self.braces())]
        if self.kind() == "name":
            ahead = 0
            while self.peek(ahead) in MODIFIERS - {"struct", "enum", "union"}:
                ahead += 1
            if ahead and self.peek(ahead) in ("class", "interface", "enum", "struct", "record", "namespace", "function") and self.kind(ahead + 1) == "name" and not self.c:
                self.i += ahead
                p = self.peek()
            handler = getattr(self, f"on_{p}", None)
            if handler and self.peek(1) not in ("=", ".", ":"):
                return handler(line)
            if p in ("default", "case"):
                raise Problem("case outside switch")
            if self.kind(1) == "op" and self.peek(1) == ":" and self.peek(2) != ":" and p not in WORDS:
                self.i += 2  # a label
                return []
            if (found := self.declaration()) is not None:
                return found
        if p == "@" or p.startswith("@") and self.language in ("java", "javascript", "typescript"):
            self.take()
            if self.peek() == "(":
                self.skip("(", ")")
            return []
        if p == "[" and self.language == "csharp":
            self.skip("[", "]")
            return []
        e = self.expr()
        self.have(";")
        return self.effects(e, line)

    def effects(self, e: Expr, line: int) -> list[Stmt]:
        """An expression statement as assignments and calls."""
        if e.kind == "seq" and e.text == "comma":
            return [s for k in e.kids for s in self.effects(k, line)]
        if e.kind == "op" and e.text in ASSIGN:
            inner = e.kids[1]
            before = self.effects(inner, line) if inner.kind == "op" and inner.text in ASSIGN else []
            value = inner.kids[0] if before else inner
            return [*before, Stmt("assign", e.line, e.kids[0], value, "" if e.text == "=" else e.text[:-1])]
        if e.kind == "op" and e.text[:2] in ("++", "--") and len(e.kids) == 1:
            return [Stmt("assign", e.line, e.kids[0], Expr("const", "", (), e.line, 1), e.text[0])]
        return [Stmt("expr", e.line or line, value=e)]

    def on_if(self, line: int) -> list[Stmt]:
        self.take()
        self.have("constexpr")
        self.take("(")
        test = self.expr()
        self.take(")")
        before: list[Stmt] = []
        if test.kind == "op" and any(k.kind == "op" and k.text == "=" for k in test.kids):  # if ((p = f()) == NULL)
            at = next(i for i, k in enumerate(test.kids) if k.kind == "op" and k.text == "=")
            before = self.effects(test.kids[at], line)
            test = Expr("op", test.text, tuple(k.kids[0] if i == at else k for i, k in enumerate(test.kids)), test.line)
        elif test.kind == "op" and test.text == "=":
            before = self.effects(test, line)
            test = test.kids[0]
        body = self.nested()
        orelse: list[Stmt] = []
        if self.peek() == "else":
            self.take()
            orelse = self.nested()
        return [*before, Stmt("if", line, value=test, body=body, orelse=orelse)]

    def on_while(self, line: int) -> list[Stmt]:
        self.take()
        self.take("(")
        test = self.expr()
        self.take(")")
        return [Stmt("loop", line, value=test, body=self.nested(), type="while")]

    def on_do(self, line: int) -> list[Stmt]:
        self.take()
        body = self.nested()
        self.take("while")
        self.take("(")
        test = self.expr()
        self.take(")")
        self.have(";")
        return [Stmt("loop", line, value=test, body=body, once=True, type="do")]

    def on_foreach(self, line: int) -> list[Stmt]:
        return self.on_for(line)

    def on_for(self, line: int) -> list[Stmt]:
        self.take()
        self.have("await")
        self.take("(")
        start = self.i
        kind = ""
        if self.peek() in ("var", "let", "const") and self.script:
            self.take()
        else:
            kind = self.type_name()
            if self.peek() in (":", "in") and kind:
                self.i = start
                kind = ""
        if self.peek() in ("[", "{") and self.script:
            target = self.primary()
        elif self.kind() == "name" and self.peek(1) in (":", "of", "in"):
            target = Expr("name", self.take().text, (), line)
        else:
            target = None
        if target is not None and self.peek() in (":", "of", "in"):
            each = self.take().text
            value = self.expr()
            self.take(")")
            return [Stmt("loop", line, target=target, value=value, body=self.nested(), type="each", op=each)]
        self.i = start
        init = [] if self.peek() == ";" else self.statement()
        if self.peek(-1) != ";":
            self.take(";")
        test = None if self.peek() == ";" else self.expr()
        self.take(";")
        step = [] if self.peek() == ")" else self.effects(self.expr(), line)
        self.take(")")
        return [*init, Stmt("loop", line, value=test, body=self.nested(), step=step, type="for")]

    def on_switch(self, line: int) -> list[Stmt]:
        self.take()
        self.take("(")
        value = self.expr()
        self.take(")")
        self.take("{")
        parts: list = []
        while self.peek() != "}" and self.i < len(self.t):
            if self.peek() in ("case", "default"):
                default = self.take().text == "default"
                label = None if default else self.ternary()
                while self.have(","):
                    self.ternary()
                arrow = self.have("->")
                if not arrow:
                    self.take(":")
                parts.append((label, []))
                if arrow:
                    parts[-1][1].extend([*self.nested(), Stmt("break", line)])
            elif parts:
                parts[-1][1].extend(self.statement())
            else:
                self.take()
        self.have("}")
        return [Stmt("switch", line, value=value, parts=parts)]

    def on_return(self, line: int) -> list[Stmt]:
        self.take()
        value = None if self.peek() in (";", "}") or self.script and self.line > line else self.expr()
        self.have(";")
        return [Stmt("return", line, value=value)]

    def on_throw(self, line: int) -> list[Stmt]:
        self.take()
        value = None if self.peek() == ";" else self.expr()
        self.have(";")
        return [Stmt("throw", line, value=value)]

    def on_break(self, line: int) -> list[Stmt]:
        kind = self.take().text
        if self.kind() == "name" and self.line == line and self.peek() not in WORDS:
            self.take()
        self.have(";")
        return [Stmt(kind, line)]

    on_continue = on_break

    def on_goto(self, line: int) -> list[Stmt]:
        self.take()
        self.take()
        self.have(";")
        return [Stmt("break", line)]

    def on_try(self, line: int) -> list[Stmt]:
        self.take()
        out: list[Stmt] = []
        if self.peek() == "(":  # resources
            self.take()
            while self.peek() != ")":
                kind = self.type_name()
                if self.peek() == "=":
                    self.i -= 1
                target = Expr("name", self.take().text, (), self.line)
                self.take("=")
                out.append(Stmt("decl", self.line, target, self.assignment(), type=kind))
                self.have(";")
            self.take(")")
        body = self.braces()
        parts, final = [], []
        while self.peek() in ("catch", "finally"):
            if self.take().text == "finally":
                final = self.braces()
                continue
            name = ""
            if self.peek() == "(":
                start = self.i + 1
                self.skip("(", ")")
                inside = [t.text for t in self.t[start : self.i - 1] if t.kind == "name"]
                name = inside[-1] if inside else ""
            if self.peek() == "when":
                self.take()
                self.skip("(", ")")
            parts.append((name, self.braces()))
        return [*out, Stmt("try", line, body=body, parts=parts, final=final)]

    def on_using(self, line: int) -> list[Stmt]:
        self.take()
        if self.peek() != "(":
            if self.language == "csharp" and (found := self.declaration()) is not None:
                return found
            while self.take().text != ";":
                pass
            return []
        self.take("(")
        out = self.declaration(")") or self.effects(self.expr(), line)
        self.have(")")
        return [*out, *self.nested()]

    def on_lock(self, line: int) -> list[Stmt]:
        self.take()
        if self.peek() == "(":
            self.skip("(", ")")
        return self.nested()

    on_synchronized = on_fixed = on_lock

    def on_import(self, line: int) -> list[Stmt]:
        while self.i < len(self.t) and (self.line == line or not self.script) and self.take().text != ";":
            pass
        return []

    on_package = on_typedef = on_import

    def on_namespace(self, line: int) -> list[Stmt]:
        while self.peek() not in ("{", ";"):
            self.take()
        if self.have(";"):
            return []
        return [Stmt("block", line, body=self.braces())]

    def on_extern(self, line: int) -> list[Stmt]:
        self.take()
        if self.kind() == "str":
            self.take()
            return self.nested()
        return self.statement()

    def on_class(self, line: int) -> list[Stmt]:
        self.take()
        name = self.take().text if self.kind() == "name" else ""
        while self.peek() not in ("{", ";") and self.i < len(self.t):
            self.take()
        if self.have(";"):
            return []
        return self.body_of_class(name)

    on_interface = on_class

    def on_struct(self, line: int) -> list[Stmt]:
        if self.kind(1) == "name" and self.peek(2) in ("{", ":") or self.peek(1) == "{":
            out = self.on_class(line)
            self.have(";")
            return out
        if (found := self.declaration()) is not None:
            return found
        raise Problem("struct")

    on_union = on_struct

    def on_record(self, line: int) -> list[Stmt]:
        if self.kind(1) != "name" or self.script or self.c:
            raise Problem("record")
        return self.on_class(line)

    def on_enum(self, line: int) -> list[Stmt]:
        while self.peek() not in ("{", ";") and self.i < len(self.t):
            self.take()
        if self.peek() == "{":
            self.skip("{", "}")
        self.have(";")
        return []

    def on_function(self, line: int) -> list[Stmt]:
        if not self.script:
            raise Problem("function")
        self.take()
        self.have("*")
        name = self.take().text
        return [Stmt("func", line, func=self.function(name, line))]

    def on_template(self, line: int) -> list[Stmt]:
        if not self.c:
            raise Problem("template")
        self.take()
        depth = 0
        while self.i < len(self.t):
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.peek(), 0)
            self.take()
            if depth <= 0:
                break
        return []

    def function(self, name: str, line: int, owner: str = "", marks: tuple[str, ...] = (), returns: str = "") -> Func:
        """Parameters and body; the opening bracket comes next."""
        start = self.i + 1
        self.skip("(", ")")
        inside = self.t[start : self.i - 1]
        f = Func(name, parameter_names(inside), [], line, owner, marks, parameter_types(inside), returns)
        self.functions.append(f)
        if self.peek() == "{":
            f.body = self.braces()
        elif self.have("=>"):
            f.body = [Stmt("return", self.line, value=self.expr())]
            self.have(";")
        return f

    def body_of_class(self, name: str) -> list[Stmt]:
        members = self.members.setdefault(name, {})
        line = self.take("{").line
        out: list[Stmt] = []
        marks: list[str] = []
        while self.i < len(self.t) and self.peek() != "}":
            at = self.i
            try:
                if self.peek() in ("public", "private", "protected") and self.peek(1) == ":":
                    self.i += 2
                    continue
                if self.peek().startswith("@") and len(self.peek()) > 1 or self.peek() == "[" and self.language == "csharp":
                    marks.append(self.annotation())
                    continue
                out += self.member(name, members, tuple(marks))
                marks = []
            except Problem:
                self.i = max(at + 1, self.i)
                while self.i < len(self.t) and self.peek() not in (";", "}", "{"):
                    self.i += 1
                if self.peek() == "{":
                    self.skip("{", "}")
                else:
                    self.have(";")
                marks = []
        self.have("}")
        return [Stmt("class", line, body=out, type=name)]

    def annotation(self) -> str:
        start = self.i
        if self.peek() == "[":
            self.skip("[", "]")
        else:
            self.take()
            while self.peek() == "." and self.kind(1) == "name":
                self.i += 2
            if self.peek() == "(":
                self.skip("(", ")")
        return "".join(t.text for t in self.t[start : self.i])

    def member(self, name: str, members: dict[str, str], marks: tuple[str, ...]) -> list[Stmt]:
        line = self.line
        if self.peek() in ("class", "struct", "interface", "enum", "record") and self.kind(1) == "name" and self.peek(2) in CLASS_HEADS:
            return getattr(self, f"on_{self.peek()}")(line)
        while self.peek() in MODIFIERS and self.peek() not in ("struct", "enum", "union"):
            self.take()
            if self.peek() in ("class", "struct", "interface", "enum", "record") and self.kind(1) == "name":
                return getattr(self, f"on_{self.peek()}")(line)
        if self.peek() == "{":
            return self.braces()
        destructor = self.have("~")
        if self.script and self.peek() in ("get", "set") and self.kind(1) == "name":
            self.take()
        self.have("#")
        if self.kind() == "name" and self.peek(1) == "(":
            own = self.take().text
            f_line = self.line
            if not self.script and own != name and not destructor:
                self.skip("(", ")")
            else:
                f = self._method(("~" if destructor else "") + own, f_line, name, marks, "")
                return [Stmt("func", f_line, func=f)]
            if self.peek() == "{":
                self.skip("{", "}")
            self.have(";")
            return []
        kind = "" if self.script else self.type_name()
        if self.peek() == "operator":
            own = self.take().text
            while self.peek() != "(":
                own += self.take().text
            f = self._method(own, line, name, marks, kind)
            return [Stmt("func", line, func=f)]
        if self.kind() != "name":
            raise Problem("member")
        own = self.take().text
        if self.peek() == "<":
            self.skip("<", ">")
        if self.peek() == "(":
            f = self._method(own, line, name, marks, kind)
            return [Stmt("func", line, func=f)]
        members[own] = kind + ("[]" if self.peek() == "[" else "")
        if self.peek() == "{" and self.language == "csharp":
            self.skip("{", "}")
            if not self.have("="):
                return []
            value = self.expr()
            self.have(";")
            return [Stmt("assign", line, Expr("attr", own, (Expr("name", "this", (), line),), line), value)]
        if self.language == "csharp" and self.have("=>"):
            self.expr()
            self.have(";")
            return []
        if self.peek() == "[":
            self.skip("[", "]")
        if self.script and self.have(":"):
            while self.peek() not in ("=", ";", "}") and self.line == line:
                self.take()
        out: list[Stmt] = []
        if self.have("="):
            out.append(Stmt("assign", line, Expr("attr", own, (Expr("name", "this", (), line),), line), self.assignment()))
        while self.have(","):
            if self.have("*"):
                pass
            members[self.take().text] = kind
            if self.have("="):
                self.assignment()
        self.have(";")
        return out

    def _method(self, own: str, line: int, name: str, marks: tuple[str, ...], returns: str) -> Func:
        start = self.i
        self.skip("(", ")")
        while self.peek() in ("const", "noexcept", "override", "final", "throws", "where") or self.kind() == "name" and self.peek() not in WORDS and self.peek(1) in (",", "{", ".") or self.peek() in (",", ".") and self.kind(1) == "name":
            self.take()
        before: list[Stmt] = []
        if self.peek() == ":" and not self.script:  # member initialisers, or a base constructor's call
            self.take()
            while self.peek() != "{" and self.i < len(self.t):
                if self.kind() == "name" and self.peek(1) in ("(", "{") and self.c:
                    target = self.take()
                    opener = self.peek()
                    args = self.listed(opener, ")" if opener == "(" else "}")
                    if args:
                        before.append(Stmt("assign", target.line, Expr("attr", target.text, (Expr("name", "this", (), target.line),), target.line), args[0]))
                else:
                    self.take()
        if self.script and self.have(":"):
            while self.peek() not in ("{", ";"):
                self.take()
        stop = self.i
        self.i = start
        inside_end = self.t[start:stop]
        f = Func(own, [], [], line, name, marks, {}, returns)
        self.functions.append(f)
        self.skip("(", ")")
        inside = self.t[start + 1 : self.i - 1]
        f.params, f.types = parameter_names(inside), parameter_types(inside)
        self.i = start + len(inside_end)
        if self.peek() == "{":
            f.body = before + self.braces()
        elif self.have("=>"):
            f.body = [Stmt("return", self.line, value=self.expr())]
            self.have(";")
        elif self.have("="):
            self.types_deleted = self.take().text
            f.marks = (*f.marks, self.types_deleted)
            self.have(";")
        else:
            f.marks = (*f.marks, "declared")
            self.have(";")
        return f

    def declaration(self, closer: str = ";") -> list[Stmt] | None:
        """A variable or function declaration, by shape; None if the text is not one."""
        start, line = self.i, self.line
        if self.script:
            if self.peek() not in ("var", "let", "const", "export", "async"):
                return None
            if self.peek() in ("export", "async"):
                self.take()
                self.have("default")
                return self.statement()
            self.take()
            out: list[Stmt] = []
            while True:
                target = self.primary() if self.peek() in ("{", "[") else Expr("name", self.take().text, (), self.line)
                if self.have(":"):
                    while self.peek() not in ("=", ";", ",") and self.line == line:
                        self.take()
                value = self.assignment() if self.have("=") else None
                out.append(Stmt("decl", target.line or line, target, value, type="let"))
                if not self.have(","):
                    break
            self.have(";")
            return out
        kind = self.type_name()
        if not kind or self.kind() != "name" or self.peek() in RANK and self.peek() not in ("is",):
            self.i = start
            return None
        if self.peek() in WORDS and self.peek() not in ("default",):
            self.i = start
            return None
        out = []
        while True:
            if self.kind() != "name":
                self.i = start
                return None
            at = self.line
            name = self.take().text
            while self.peek() == "::" and self.kind(1) in ("name", "op"):
                name += self.take().text + self.take().text
                if self.kind() == "name" and name.endswith("~"):
                    name += self.take().text
            if self.peek() == "(":
                mark = self.i
                self.skip("(", ")")
                while self.peek() in ("const", "noexcept", "override", "throws") or self.kind() == "name" and self.peek(1) in ("{", ","):
                    self.take()
                if self.peek() in ("{", "=>") or self.peek() == ":" and self.c:
                    self.i = mark
                    owner, _, own = name.rpartition("::")
                    f = self._method(own, at, owner, (), kind) if self.peek() == "(" else None
                    return [Stmt("func", at, func=f)]
                if self.peek() == ";" and self.c and self.types_only(mark):
                    self.take()
                    return []
                self.i = mark
                if not self.c:
                    self.i = start
                    return None
                args = self.listed("(", ")")
                out.append(Stmt("decl", at, Expr("name", name, (), at), Expr("new", "", (Expr("name", kind, (), at), *args), at), type=kind))
            else:
                size = None
                own = kind
                while self.peek() == "[":
                    self.take()
                    size = None if self.peek() == "]" else self.expr()
                    self.take("]")
                    own = kind + "[]"
                value = None
                if self.have("="):
                    value = self.literal() if self.peek() == "{" else self.assignment()
                elif self.peek() == "{" and self.c:
                    value = self.literal()
                elif self.peek() not in (",", closer, ";"):
                    self.i = start
                    return None
                out.append(Stmt("decl", at, Expr("name", name, (), at), value, type=own, size=size))
            if not self.have(","):
                break
            while self.peek() in ("*", "&"):
                self.take()
        if closer == ";":
            self.have(";")
        return out

    def types_only(self, mark: int) -> bool:
        """Whether a bracket holds parameter types rather than arguments."""
        inside = [t for t in self.t[mark + 1 : self.i - 1]]
        return not inside or any(t.text in PLAIN_TYPES or t.text == "struct" for t in inside) or any(a.kind == "name" and b.kind == "name" for a, b in zip(inside, inside[1:], strict=False))


def _split(toks: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in toks:
        if t.kind == "op":
            depth += {"(": 1, "[": 1, "{": 1, "<": 1, ")": -1, "]": -1, "}": -1, ">": -1, ">>": -2}.get(t.text, 0)
            if t.text == "," and depth <= 0:
                out.append([])
                continue
        out[-1].append(t)
    return [p for p in out if p]


def _named(part: list[Token]) -> str:
    words: list[str] = []
    for t in part:
        if t.kind == "op" and t.text in ("=", ":", "["):
            break
        if t.kind == "name":
            words.append(t.text)
    if part[0].text in ("{", "["):
        return ""
    return words[-1] if words else ""


def _bare(part: list[Token]) -> list[Token]:
    """A parameter without attributes in square brackets before it."""
    while part[0].text == "[" and part[-1].kind == "name":
        part = part[next(i for i, t in enumerate(part) if t.text == "]") + 1 :]
    return part


def parameter_names(toks: list[Token]) -> list[str]:
    """Names in order; of a destructured parameter, the names inside it."""
    out: list[str] = []
    for part in _split(toks):
        part = _bare(part)
        if part[0].text in ("{", "["):
            out += [t.text for t in part if t.kind == "name"]
        elif name := _named(part):
            if name not in PLAIN_TYPES:
                out.append(name)
    return out


def parameter_types(toks: list[Token]) -> dict[str, str]:
    out = {}
    for part in _split(toks):
        part = _bare(part)
        name = _named(part)
        words = [t.text for t in part if t.text not in ("final", "const")]
        if name in words:
            out[name] = "".join(w for w in words[: words.index(name)] if w not in ("=",)) + ("[]" if "[" in words[words.index(name) :] else "")
    return out


def read(text: str, language: str) -> Module:
    p = Parser(tokens(text, language in ("javascript", "typescript")), language)
    body: list[Stmt] = []
    try:
        while p.i < len(p.t):
            before = p.i
            body += p.statement()
            if p.i == before:
                p.i += 1
    except RecursionError:
        return Module(language, [], [], error="nested too deeply")
    except (IndexError, ValueError) as problem:
        return Module(language, body, p.functions, p.members, error=f"line {p.line}: {problem}")
    return Module(language, body, p.functions, p.members)
