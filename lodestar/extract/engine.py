"""A table-driven extractor: languages are rule tables over one matching engine.

A rule is a pattern and what a match yields. The engine finds lines by bisection, drops relationships on comment
lines, and builds the records; languages only declare rules, containers and how a block ends.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from lodestar.extract.comments import code_lines
from lodestar.functions.compat import go_json


def rx(pattern: str) -> re.Pattern:
    """A linear-time dialect's pattern as Python's: ASCII classes, and white space without the vertical tab."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append((r"\t\n\f\r " if inside else r"[\t\n\f\r ]") if two == r"\s" else (r"[^\t\n\f\r ]" if two == r"\S" and not inside else two))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        else:
            inside = inside and c != "]"
            out.append(r"\[" if inside and c == "[" else c)
        i += 1
    return re.compile("".join(out), re.ASCII)


def cut(s: str, most: int, tail: str = "") -> str:
    """At most `most` UTF-8 bytes, and then the tail."""
    raw = s.encode("utf-8", "replace")
    return s if len(raw) <= most else raw[:most].decode("utf-8", "replace") + tail


class Source:
    """A text with its lines and comment flags."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.text, self.language = path, text, language
        self.lines = text.split("\n")
        self.flags = code_lines(text, language)
        self._breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, offset: int) -> int:
        return bisect_right(self._breaks, offset - 1) + 1 if offset else 1

    @cached_property
    def blocks(self) -> BraceBlocks:
        return BraceBlocks(self.text)

    def is_code(self, line: int) -> bool:
        return line <= len(self.flags) and self.flags[line - 1]


def reference(kind: str, confidence: str, target: str, line: int = 0, start: str = "", to: str = "") -> dict:
    return {"from_symbol_name": start, "to_symbol_name": to, "reference_kind": kind, "confidence": confidence, "line": line, "raw_target_text": target}


def artifact(kind: str, name: str, data: dict[str, str], confidence: str) -> dict:
    return {"artifact_kind": kind, "name": name, "data_json": go_json(data), "confidence": confidence}


def symbol(src: Source, name: str, qualified: str, kind: str, visibility: str, start: int = 0, end: int = 0, parent: str = "", signature: str = "", doc: str = "") -> dict:
    return {
        "name": name, "qualified_name": qualified, "symbol_kind": kind, "visibility": visibility, "parent": parent, "signature": signature, "doc_comment": doc,
        "start_line": start, "end_line": end, "stable_id": f"{src.language}:{qualified}:{kind}",
    }


@dataclass(frozen=True)
class Hit:
    """What a rule's match yields: a reference (kind, confidence, target), an artifact (kind, name, data, confidence)."""

    ref: tuple[str, str, str] | None = None
    art: tuple[str, str, dict, str] | None = None


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    make: Callable[[re.Match], Hit | None]


def rule(pattern: str, make: Callable[[re.Match], Hit | None]) -> Rule:
    return Rule(rx(pattern), make)


def route(method: str, path: str, handler: str = "", confidence: str = "exact", named: bool = False) -> Hit:
    """named: the reference's target is the method and the path."""
    name = f"{method} {path}"
    return Hit(("registers_route", confidence, name if named else path), ("route", name, {"method": method, "path": path, "handler": handler}, confidence))


def setting(key: str, kind: str, data: dict[str, str], confidence: str = "exact") -> Hit:
    return Hit(("uses_config", confidence, key), (kind, key, data, confidence))


def service(name: str, target: str | None, data: dict[str, str], kind: str = "external_service") -> Hit:
    return Hit(("invokes_external_api", "heuristic", target) if target is not None else None, (kind, name, data, "heuristic"))


def job(name: str, kind: str) -> Hit:
    return service(name, None, {"type": kind, "name": name}, "background_job")


def apply_rules(src: Source, rules: Iterable[Rule]) -> tuple[list[dict], list[dict]]:
    refs, arts = [], []
    for r in rules:
        for m in r.pattern.finditer(src.text):
            line = src.line(m.start())
            if src.is_code(line) and (hit := r.make(m)):
                if hit.ref:
                    refs.append(reference(hit.ref[0], hit.ref[1], hit.ref[2], line))
                if hit.art:
                    arts.append(artifact(*hit.art))
    return refs, arts


def imports(src: Source, *patterns: re.Pattern) -> list[dict]:
    return [reference("imports", "exact", m[1].strip(), src.line(m.start()), to=m[1].strip()) for p in patterns for m in p.finditer(src.text)]


@dataclass(frozen=True)
class CallRule:
    """Call sites: a pattern, how the target is written, words that are no calls; at group 1 or at the match."""

    pattern: re.Pattern
    target: Callable[[re.Match], str]
    stop: frozenset[str]
    word: int
    at_group: bool = False


def calls(src: Source, rules: Iterable[CallRule]) -> list[dict]:
    """Each target once a line."""
    out, seen = [], set()
    for r in rules:
        for m in r.pattern.finditer(src.text):
            line = src.line(m.start(1) if r.at_group else m.start())
            target = r.target(m)
            if m[r.word] in r.stop or not src.is_code(line) or (line, target) in seen:
                continue
            seen.add((line, target))
            out.append(reference("calls", "heuristic", target, line))
    return out


def call_rules(direct: str, selector: str, stop: str, builtins: str = "") -> list[CallRule]:
    words = frozenset(stop.split())
    return [CallRule(rx(direct), lambda m: m[1], words | frozenset(builtins.split()), 1, True), CallRule(rx(selector), lambda m: f"{m[1]}.{m[2]}", words, 2)]


# ---- SQL

#: What starts a statement in a literal, and words that make a line look like SQL.
STATEMENT = rx(r"(?i)^\s*(CREATE\s+TABLE|ALTER\s+TABLE|INSERT|SELECT|UPDATE|DELETE|DROP)")
SQL_WORD = rx(r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|FROM|WHERE|JOIN|TABLE|INDEX)\b")


def statement_kind(text: str) -> str | None:
    m = STATEMENT.match(text)
    if not m:
        return None
    first = m[1].split()[0].upper()
    return {"CREATE": "CREATE TABLE", "ALTER": "ALTER TABLE"}.get(first, first)


def migration(src: Source, marks: Iterable[str], line: int, confidence: str = "exact", most: int | None = None) -> tuple[list[dict], list[dict]]:
    if not any(x in src.path for x in marks):
        return [], []
    return [reference("migrates", confidence, cut(src.path, most) if most else src.path, line)], [artifact("migration", src.path, {"file": src.path, "type": "migration"}, confidence)]


def sql_literals(src: Source, found: Iterable[tuple[str, int]], typed: bool, by_line: bool = False) -> tuple[list[dict], list[dict]]:
    """Literals (text, line) on code lines that start like a statement; typed: the kind names the artifact."""
    refs, arts, seen = [], [], set()
    for text, line in found:
        kind = statement_kind(text)
        if kind is None or not src.is_code(line) or by_line and line in seen:
            continue
        seen.add(line)
        query = cut(text, 200)
        arts.append(artifact("sql_query", kind if typed else query, {"query": query, "type": kind} if typed else {"query": query}, "heuristic"))
        refs.append(reference("touches_table", "heuristic", cut(text, 100), line))
    return refs, arts


def literals(src: Source, pattern: re.Pattern) -> list[tuple[str, int]]:
    return [(m[1], src.line(m.start())) for m in pattern.finditer(src.text)]


# ---- blocks and test names


class BraceBlocks:
    """All brace blocks of a text, found in one pass.

    A brace opened at some level is closed by the next closing brace that comes back to it. The block of a line is
    that of the first brace at or after the line which opens at the level the line begins with.
    """

    def __init__(self, text: str):
        self.places: list[int] = []  # line index of every brace
        self.levels: list[int] = []  # level before it
        self.opened: dict[int, list[int]] = {}  # level -> numbers of the braces opened there
        self.closed: dict[int, int] = {}  # number of an opening brace -> line index of its partner
        line = level = 0
        for c in re.findall(r"[{}\n]", text):
            if c == "\n":
                line += 1
                continue
            if c == "{":
                self.opened.setdefault(level, []).append(len(self.places))
            elif level - 1 in self.opened:
                self.closed.setdefault(self.opened[level - 1][-1], line)
            self.places.append(line)
            self.levels.append(level)
            level += 1 if c == "{" else -1

    def end(self, line: int) -> int:
        """1-based line that closes the block of a 1-based line, else that line."""
        first = bisect_left(self.places, line - 1)
        same = self.opened.get(self.levels[first], []) if first < len(self.places) else []
        k = bisect_left(same, first)
        return self.closed.get(same[k], line - 1) + 1 if k < len(same) else line


def marked_lines(lines: list[str], is_mark: Callable[[str], bool], lead: str, reach: int = 3) -> list[bool]:
    """Which lines a mark stands before, at most reach lines above, with only blank lines and lines begun by lead between."""
    out, last = [], None
    for i, line in enumerate(map(str.strip, lines)):
        out.append(last is not None and i - last <= reach)
        if is_mark(line):
            last = i
        elif line and not line.startswith(lead):
            last = None
    return out


@dataclass(frozen=True)
class TestNames:
    """How a test's name leads to what it tests: prefixes to strip, letter case, the name itself first or last."""

    prefixes: tuple[str, ...] = ("test", "Test")
    separator: str = "."
    confidence: str = "heuristic"
    fold: bool = False
    itself_first: bool = True
    skip: Callable[[str], bool] = field(default=lambda name: False)

    def references(self, symbols: list[dict], module: str) -> list[dict]:
        key = (lambda s: s.lower()) if self.fold else (lambda s: s)
        known = {key(s["name"]): s["name"] for s in symbols if s["symbol_kind"] != "test"}
        out = []
        for s in symbols:
            if s["symbol_kind"] != "test" or self.skip(s["name"]):
                continue
            stripped = [c for p in self.prefixes if s["name"].startswith(p) for c in self._forms(s["name"][len(p) :])]
            order = [s["name"], *stripped] if self.itself_first else [*stripped, s["name"]]
            hit = next((known[key(c)] for c in order if key(c) in known), None)
            if hit is not None:
                out.append(reference("tests", self.confidence, hit, s["start_line"], s["qualified_name"], f"{module}{self.separator}{hit}"))
        return out

    def _forms(self, rest: str) -> list[str]:
        return [rest] if self.fold or not rest else [rest, rest[0].lower() + rest[1:]]


def stem(path: str) -> str:
    return posixpath.splitext(path)[0] if posixpath.basename(path).rfind(".") > 0 else path.rpartition(".")[0] or path


def package_of(src: Source, module: str, name: str | None = None) -> dict:
    return {"name": posixpath.basename(stem(src.path)) if name is None else name, "import_path": module, "directory_path": posixpath.dirname(src.path) or ".", "language": src.language}


def result(package: dict | None, symbols: list[dict], refs: list[dict], arts: list[dict], status: str = "ok", diagnostics: list[dict] | None = None) -> dict:
    return {"parse_status": status, "package": package, "symbols": symbols, "refs": refs, "artifacts": arts, "diagnostics": diagnostics or []}


def merged(*parts: tuple[list[dict], list[dict]]) -> tuple[list[dict], list[dict]]:
    return [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
