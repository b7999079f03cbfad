"""Go: a lexer with automatic semicolons, a declaration parser, and call sites read from the token stream."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from lodestar.extract.engine import Source, artifact, cut, reference, result, symbol

# Keywords, tokens after which a line end closes a statement, HTTP verbs, call patterns.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDERS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
VERBS = frozenset("GET POST PUT DELETE PATCH HEAD OPTIONS".split())
SERVICES = {("http", "Get"), ("http", "Post"), ("http", "NewRequest"), ("http", "Do"), ("rpc", "Dial"), ("grpc", "Dial")}
JOBS = {("cron", "AddFunc"), ("scheduler", "Every")}
SQL_STARTS = ("CREATE TABLE", "ALTER TABLE", "INSERT", "SELECT")
_TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)|(?P<rune>'(?:\\.[^'\n]*|[^'\\\n])')"
    r"|(?P<number>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<name>[^\W\d]\w*)|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!~()\[\]{},;.:])",
    re.S,
)


class ParseError(Exception):
    pass


@dataclass
class Token:
    kind: str
    text: str
    line: int


def lex(text: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens with the semicolons that line ends imply, and comments as (first line, last line, text)."""
    out, comments, at, line = [], [], 0, 1

    def close() -> None:
        if out and (out[-1].kind in ("name", "number", "string", "rune") and (out[-1].text not in KEYWORDS or out[-1].text in ENDERS) or out[-1].text in ENDERS):
            out.append(Token("op", ";", out[-1].line))

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"{line}: illegal character {text[at]!r}")
        kind, got = m.lastgroup, m[0]
        at = m.end()
        if kind == "newline":
            close()
        elif kind in ("line", "block"):
            comments.append((line, line + got.count("\n"), got))
            if "\n" in got:
                close()
        elif kind != "space":
            out.append(Token(kind, got, line))
        line += got.count("\n")
    close()
    return out, comments


def doc_text(comments: list[str]) -> str:
    """The text of a comment group: markers and directives gone, blank lines single, one line end."""
    lines: list[str] = []
    for c in comments:
        if c.startswith("//"):
            body = c[2:]
            if re.match(r"[a-z0-9]+:[a-z0-9]|line |extern |export ", body):
                continue
            lines.append(body[1:] if body.startswith(" ") else body)
        else:
            lines += c[2:-2].split("\n")
    out: list[str] = []
    for x in (x.rstrip(" \t\r\n") for x in lines):
        if x or out and out[-1]:
            out.append(x)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n" if out else ""


class Parser:
    def __init__(self, text: str):
        self.t, comments = lex(text)
        self.match = self._brackets()
        self.groups: dict[int, list[str]] = {}  # comment groups by the line after them
        first: list[str] = []
        last = -1
        code = {x.line for x in self.t}
        for a, b, c in comments:
            if a in code and not c.startswith("/*"):
                first, last = [], -1
                continue
            first = [*first, c] if a == last + 1 else [c]
            last = b
            self.groups[b + 1] = first

    def _brackets(self) -> dict[int, int]:
        pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, x in enumerate(self.t):
            if x.kind != "op":
                continue
            if x.text in "([{":
                stack.append(i)
            elif x.text in pairs:
                if not stack or self.t[stack[-1]].text != pairs[x.text]:
                    raise ParseError(f"{x.line}: unexpected {x.text}")
                out[stack[-1]] = i
                out[i] = stack.pop()
        if stack:
            raise ParseError(f"{self.t[stack[-1]].line}: {self.t[stack[-1]].text} is not closed")
        return out

    def is_(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i].text == text and self.t[i].kind != "string"

    def name(self, i: int) -> str:
        if i >= len(self.t) or self.t[i].kind != "name" or self.t[i].text in KEYWORDS:
            raise ParseError(f"{self.t[min(i, len(self.t) - 1)].line if self.t else 1}: a name is expected")
        return self.t[i].text

    def ident(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and self.t[i].text not in KEYWORDS

    def end(self, i: int) -> int:
        """Index of the semicolon that ends what starts at i, brackets skipped."""
        while i < len(self.t) and not self.is_(i, ";"):
            if self.t[i].kind == "op" and self.t[i].text in ")]}":
                return i
            i = self.match[i] + 1 if self.t[i].kind == "op" and self.t[i].text in "([{" else i + 1
        return i

    def doc(self, i: int) -> str:
        return doc_text(self.groups.get(self.t[i].line, []))

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges between the commas of a list."""
        out, start, i = [], a, a
        while i < b:
            if self.is_(i, ","):
                out.append((start, i))
                start = i + 1
            i = self.match[i] + 1 if self.t[i].kind == "op" and self.t[i].text in "([{" else i + 1
        if start < b:
            out.append((start, b))
        return out

    # ---- types
    def type_text(self, a: int, b: int) -> str:
        """A type expression, written the short way; what is not a plain form is unknown."""
        if a >= b:
            return "unknown"
        x = self.t[a].text
        if x == "*":
            return "*" + self.type_text(a + 1, b)
        if x == "...":
            return "..." + self.type_text(a + 1, b)
        if x == "[":
            return "[]" + self.type_text(self.match[a] + 1, b)
        if x == "map":
            close = self.match[a + 1]
            return f"map[{self.type_text(a + 2, close)}]{self.type_text(close + 1, b)}"
        if x == "interface":
            return "interface{}"
        if x == "func":
            return "func(...)"
        if x == "chan":
            return "chan " + self.type_text(a + (2 if self.is_(a + 1, "<-") else 1), b)
        if x == "<-" and self.is_(a + 1, "chan"):
            return "chan " + self.type_text(a + 2, b)
        if self.ident(a) and b == a + 1:
            return x
        if self.ident(a) and self.is_(a + 1, ".") and b == a + 3:
            return f"{x}.{self.t[a + 2].text}"
        return "unknown"

    def fields(self, a: int, b: int) -> list[tuple[list[str], int, int]]:
        """Parameters between parentheses: (names, type range)."""
        parts = self.split(a, b)

        def named(p: tuple[int, int]) -> bool:
            if p[1] - p[0] < 2 or not self.ident(p[0]) or self.is_(p[0] + 1, "."):
                return False
            return not (self.is_(p[0] + 1, "[") and self.match[p[0] + 1] == p[1] - 1)

        if not any(map(named, parts)):
            return [([], *p) for p in parts]
        out, names = [], []
        for p in parts:
            names.append(self.name(p[0]))
            if named(p):
                out.append((names, p[0] + 1, p[1]))
                names = []
        if names:
            raise ParseError(f"{self.t[a].line}: mixed named and unnamed parameters")
        return out

    def listed(self, fields: list[tuple[list[str], int, int]]) -> list[str]:
        return [x for names, a, b in fields for t in [self.type_text(a, b)] for x in ([f"{n} {t}" for n in names] or [t])]


def _callee_start(p: Parser, i: int) -> int:
    """First token of the primary expression whose last name is token i."""
    while i >= 2 and p.is_(i - 1, "."):
        i -= 2
        while p.t[i].kind == "op" and p.t[i].text in ")]}":
            i = p.match[i] - 1
            if i < 0 or not (p.ident(i) or p.t[i].kind == "op" and p.t[i].text in ")]}"):
                return i + 1
    return i


def _plain(p: Parser, a: int, b: int) -> str:
    """Names joined by dots, or a literal; anything else is empty."""
    if b == a + 1:
        return p.t[a].text.strip('"') if p.t[a].kind in ("string", "number", "rune") else p.t[a].text if p.ident(a) else ""
    parts = p.t[a:b]
    ok = len(parts) % 2 and all((p.ident(a + k) if k % 2 == 0 else x.text == ".") for k, x in enumerate(parts))
    return "".join(x.text for x in parts) if ok else ""


def _first_text(p: Parser, args: list[tuple[int, int]]) -> tuple[str, str]:
    a, b = args[0]
    return (p.t[a].text.strip('"'), "exact") if b == a + 1 and p.t[a].kind == "string" else (_plain(p, a, b), "heuristic")


def _uses(src: Source, p: Parser, package: str, skip: list[tuple[int, int]]) -> tuple[dict, list[dict]]:
    """References by group and artifacts by group, from every call, go statement and string of the file."""
    refs: dict[str, list] = {k: [] for k in ("calls", "routes", "config", "sql", "jobs")}
    arts: dict[str, list] = {k: [] for k in ("routes", "config", "sql", "jobs")}
    jump = dict(skip)
    i = 0
    while i < len(p.t):
        if i in jump:
            i = jump[i]
            continue
        x = p.t[i]
        if x.text == "interface" and x.kind == "name" and p.is_(i + 1, "{"):
            i = p.match[i + 1] + 1
            continue
        if x.kind == "string":
            value = x.text.strip('`"')
            kind = next((s for s in SQL_STARTS if value.strip().upper().startswith(s)), None)
            if kind:
                arts["sql"].append(artifact("sql_query", kind, {"query": cut(value, 200, "..."), "type": kind}, "heuristic"))
                refs["sql"].append(reference("touches_table", "heuristic", cut(value, 100, "..."), x.line))
        elif x.text == "go" and x.kind == "name" and i + 1 < len(p.t):
            j = i + 1
            while p.is_(j + 1, ".") and p.ident(j + 2):
                j += 2
            name = "anonymous" if p.is_(i + 1, "func") else _plain(p, i + 1, j + 1) if p.ident(i + 1) and p.is_(j + 1, "(") else "goroutine"
            arts["jobs"].append(artifact("background_job", name or "goroutine", {"name": name or "goroutine", "type": "goroutine"}, "heuristic"))
        elif p.ident(i) and p.is_(i + 1, "("):
            args = p.split(i + 2, p.match[i + 1])
            if not p.is_(i - 1, "."):
                refs["calls"].append(reference("calls", "exact", f"{package}.{x.text}", x.line))
            else:
                _method_call(p, i, args, refs, arts)
        i += 1
    return refs, arts


def _method_call(p: Parser, i: int, args: list[tuple[int, int]], refs: dict, arts: dict) -> None:
    method, start = p.t[i].text, _callee_start(p, i)
    line = p.t[start].line
    owner = p.t[i - 2].text if p.ident(i - 2) and not p.is_(i - 3, ".") else None
    if owner:
        refs["calls"].append(reference("calls", "likely", f"{owner}.{method}", line))
    verb = "ANY" if method in ("HandleFunc", "Handle") else method.upper() if method.upper() in VERBS else None
    if verb and len(args) >= 2:
        path, confidence = _first_text(p, args)
        if path:
            arts["routes"].append(artifact("route", f"{verb} {path}", {"method": verb, "path": path, "handler": _plain(p, *args[1])}, confidence))
            refs["routes"].append(reference("registers_route", confidence, path, line))
    kind = "env_var" if owner == "os" and method in ("Getenv", "LookupEnv") else "config_key" if owner == "viper" and method.startswith("Get") else None
    if kind and args and (name := _first_text(p, args)[0]):
        arts["config"].append(artifact(kind, name, {"key": name, "source": f"{owner}.{method}"}, "exact"))
        refs["config"].append(reference("uses_config", "exact", name, line))
    full = f"{owner}.{method}"
    if (owner, method) in JOBS:
        name, confidence = _first_text(p, args) if args else ("", "")
        arts["jobs"].append(artifact("background_job", name if confidence == "exact" else full, {"type": "scheduled", "source": full}, "heuristic"))
    if (owner, method) in SERVICES:
        arts["jobs"].append(artifact("external_service", full, {"type": "http_client", "source": full}, "heuristic"))
        refs["jobs"].append(reference("invokes_external_api", "heuristic", full, line))


def _shown(name: str) -> str:
    return "exported" if name[:1].isascii() and name[:1].isupper() else "unexported"


def go(path: str, text: str, language: str = "go", module_path: str = "") -> dict:
    src = Source(path, text, language)
    try:
        return _file(src, Parser(text), module_path)
    except (ParseError, IndexError, KeyError) as e:
        return result(None, [], [], [], "error", [{"severity": "error", "code": "PARSE_ERROR", "message": f"parse error: {path}:{e}"}])


def _file(src: Source, p: Parser, module_path: str) -> dict:
    if not p.is_(0, "package"):
        raise ParseError("1: expected package")
    package = p.name(1)
    folder = posixpath.dirname(src.path)
    symbols: list[dict] = []
    refs: list[dict] = []
    methods: dict[str, list[str]] = {}
    interfaces: dict[str, list[str]] = {}
    skip: list[tuple[int, int]] = []
    i = p.end(0) + 1
    while i < len(p.t):
        x = p.t[i].text
        if x == ";":
            i += 1
        elif x == "func":
            i = _function(src, p, i, package, symbols, methods, skip)
        elif x in ("import", "type", "const", "var"):
            grouped = p.is_(i + 1, "(")
            stop = p.match[i + 1] if grouped else p.end(i)
            specs, at = [], i + 2 if grouped else i + 1
            while at < stop:
                e = min(p.end(at), stop)
                if e > at:
                    specs.append((at, e))
                at = e + 1
            for a, b in specs:
                doc = (p.doc(a) if grouped else "") or (p.doc(i) if len(specs) == 1 else "")
                if x == "import":
                    lit = p.t[b - 1]
                    if lit.kind != "string":
                        raise ParseError(f"{lit.line}: import path must be a string")
                    refs.append(reference("imports", "exact", lit.text.strip('"'), p.t[a].line))
                elif x == "type":
                    _type(src, p, a, b, package, doc, symbols, interfaces)
                else:
                    _values(src, p, a, b, x, package, doc, symbols)
            i = p.end(stop) + 1
        else:
            raise ParseError(f"{p.t[i].line}: expected declaration, found {x}")
    used, arts = _uses(src, p, package, skip)
    refs += used["calls"]
    for owner, has in methods.items():
        refs += [reference("implements", "exact", f"{package}.{n}", 0, f"{package}.{owner}", f"{package}.{n}") for n, need in interfaces.items() if need and set(need) <= set(has)]
    refs += used["routes"] + used["config"]
    moved: list[dict] = []
    if "migrations/" in src.path or "migrate/" in src.path:
        moved = [artifact("migration", src.path, {"file": src.path, "type": "migration"}, "exact")]
        refs.append(reference("migrates", "exact", src.path))
    refs += used["sql"] + used["jobs"]
    for s in symbols:
        head = {"test": "Test", "benchmark": "Benchmark"}.get(s["symbol_kind"])
        target = s["name"][len(head) :] if head and s["name"].startswith(head) else ""
        if target:
            target = target[: target.index("_")] if target.find("_") > 0 else target
            refs.append(reference("tests", "heuristic", target, s["start_line"], s["qualified_name"], f"{package}.{target}"))
    where = "/".join(x for x in (module_path, folder) if x)
    return result({"name": package, "import_path": where, "directory_path": folder, "language": "go"}, symbols, refs, arts["routes"] + arts["config"] + moved + arts["sql"] + arts["jobs"])


def _function(src: Source, p: Parser, i: int, package: str, symbols: list[dict], methods: dict, skip: list) -> int:
    at, owner = i + 1, ""
    if p.is_(at, "("):
        fields = p.fields(at + 1, p.match[at])
        if not fields:
            raise ParseError(f"{p.t[at].line}: method has no receiver")
        _, a, b = fields[0]
        while p.is_(a, "*"):
            a += 1
        owner = p.t[a].text if b == a + 1 and p.ident(a) else "unknown"
        at = p.match[at] + 1
    name = p.name(at)
    if p.is_(at + 1, "["):
        at = p.match[at + 1]
    if not p.is_(at + 1, "("):
        raise ParseError(f"{p.t[at].line}: expected (")
    close = p.match[at + 1]
    params = p.fields(at + 2, close)
    stop = p.end(i)
    body = next((k for k in range(stop - 1, close, -1) if p.is_(k, "}") and k == stop - 1), None)
    opened = p.match[body] if body is not None and not _is_type_brace(p, p.match[body], close) else None
    results_end = opened if opened is not None else stop
    if p.is_(close + 1, "(") and p.match[close + 1] < results_end:
        results = p.listed(p.fields(close + 2, p.match[close + 1]))
    else:
        results = [p.type_text(close + 1, results_end)] if results_end > close + 1 else []
    sig = f"func {f'({owner}) ' if owner else ''}{name}({', '.join(p.listed(params))})" + (f" {results[0]}" if len(results) == 1 else f" ({', '.join(results)})" if results else "")
    takes = lambda t: any(b == a + 4 and p.is_(a, "*") and p.is_(a + 2, ".") and p.t[a + 3].text == t for _, a, b in params)
    kind = "method" if owner else "test" if name.startswith("Test") and takes("T") else "benchmark" if name.startswith("Benchmark") and takes("B") else "entrypoint" if name == package == "main" and "cmd/" in src.path else "function"
    if owner:
        methods.setdefault(owner, []).append(name)
    qualified = f"{package}.{owner}.{name}" if owner else f"{package}.{name}"
    symbols.append(symbol(src, name, qualified, kind, _shown(name), p.t[i].line, p.t[stop - 1].line, signature=sig, doc=p.doc(i)))
    skip.append((i, opened if opened is not None else stop))
    return stop + 1


def _is_type_brace(p: Parser, opened: int, close: int) -> bool:
    """Whether the brace belongs to a result type (interface{} or struct{}), of a function without a body."""
    return opened - 1 > close and p.t[opened - 1].text in ("interface", "struct") and p.t[opened - 1].kind == "name"


def _type(src: Source, p: Parser, a: int, b: int, package: str, doc: str, symbols: list[dict], interfaces: dict) -> None:
    name = p.name(a)
    at = a + 1
    if p.is_(at, "[") and not p.is_(at + 1, "]") and p.ident(at + 1) and p.match[at] > at + 2:
        at = p.match[at] + 1
    at += p.is_(at, "=")
    if at >= b:
        raise ParseError(f"{p.t[a].line}: expected type")
    kind = {"struct": "struct", "interface": "interface"}.get(p.t[at].text, "type")
    if kind == "struct":
        k, stop = at + 2, p.match[at + 1]
        while k < stop:
            e = min(p.end(k), stop)
            names = []
            while p.ident(k) and (p.is_(k + 1, ",") or names or e > k + 1 and not p.is_(k + 1, ".") and p.t[k + 1].kind != "string" and not (p.is_(k + 1, "[") and p.match[k + 1] == e - 1)):
                names.append(k)
                if not p.is_(k + 1, ","):
                    break
                k += 2
            for n in names:
                f = p.t[n].text
                symbols.append(symbol(src, f, f"{package}.{name}.{f}", "field", _shown(f), p.t[names[0]].line, p.t[e - 1].line, f"{package}.{name}"))
            k = e + 1
    elif kind == "interface":
        k, stop, need = at + 2, p.match[at + 1], []
        while k < stop:
            if p.ident(k) and p.is_(k + 1, "("):
                need.append(p.t[k].text)
            k = min(p.end(k), stop) + 1
        interfaces[name] = need
    symbols.append(symbol(src, name, f"{package}.{name}", kind, _shown(name), p.t[a].line, p.t[b - 1].line, doc=doc))


def _values(src: Source, p: Parser, a: int, b: int, kind: str, package: str, doc: str, symbols: list[dict]) -> None:
    at, names = a, [p.name(a)]
    while p.is_(at + 1, ","):
        at += 2
        names.append(p.name(at))
    symbols.extend(symbol(src, n, f"{package}.{n}", kind, _shown(n), p.t[a].line, p.t[b - 1].line, doc=doc) for n in names if n != "_")
