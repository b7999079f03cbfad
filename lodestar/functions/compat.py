"""Column helpers: ASCII LIKE, globs, byte truncation, path parts, times."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like(c: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z only; % and _ are live in the pattern and a backslash is itself."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER)).replace("|", "||")
    return F.like(ascii_lower(c), F.lit(folded), F.lit("|"))


def contains(c: Column, needle: str) -> Column:
    return like(c, f"%{needle}%")


def glob_to_regex(glob: str) -> str | None:
    """An anchored regular expression (RE2 subset) for a doublestar glob; None for a malformed one."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**", i):
                at_start, rest = i == 0 or glob[i - 1] == "/", glob[i + 2 :]
                if at_start and rest.startswith("/"):
                    out.append("(?:[^/]+/)*")
                    i += 3
                    continue
                if at_start and not rest:
                    if out and out[-1] == "/":
                        out[-1] = "(?:/.*)?"
                    else:
                        out.append(".*")
                    i += 2
                    continue
                out.append("[^/]*")
                i += 2
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            neg = body[0] in "!^"
            out.append("[" + "^/" * neg + re.sub(r"([\\\[&~])", r"\\\1", body[neg:]) + "]")
            i = end
        elif c == "\\":
            if i + 1 >= len(glob):
                return None
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return None if depth else "(?s)^" + "".join(out) + "$"


def glob_any(path: Column, globs: list[str]) -> Column:
    """Whether any well-formed pattern matches."""
    hit = F.lit(False)
    for g in globs:
        rx = glob_to_regex(g)
        if rx:
            hit = hit | path.rlike(rx)
    return hit


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include pattern (none: all) and no exclude pattern."""
    keep = glob_any(path, include) if include else F.lit(True)
    return keep & ~glob_any(path, exclude) if exclude else keep


def truncate_bytes(s: Column, most: int) -> Column:
    """At most `most` UTF-8 bytes: the first most-3 and three dots; a cut character becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, most - 3).cast("string"))
    return F.when(F.octet_length(s) > most, F.concat(head, F.lit("..."))).otherwise(s)


# Language by extension. The short list is what the walker of the compatible mode knows.
CORE_LANGUAGES = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
EXTENDED_LANGUAGES = CORE_LANGUAGES | {".py": "python", ".pyi": "python", ".rs": "rust", ".java": "java", ".cs": "csharp", ".swift": "swift", ".lua": "lua"}


def language_of(path: Column, extended: bool = True) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in (EXTENDED_LANGUAGES if extended else CORE_LANGUAGES).items() for x in kv])
    return F.coalesce(F.element_at(table, ext), F.lit(""))


def generated_flag(path: Column, first_bytes: Column) -> Column:
    """Path has `generated` or `gen/`, or the first line (of 256 bytes) starts with the generator's mark."""
    line = F.substring_index(F.make_valid_utf8(F.substring(first_bytes, 1, 256).cast("string")), "\n", 1)
    return F.contains(path, F.lit("generated")) | F.contains(path, F.lit("gen/")) | line.startswith("// Code generated")


def go_json(obj: dict[str, str]) -> str:
    """Compact JSON with sorted keys, <, >, & and the line separators escaped."""
    s = json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&  ":
        s = s.replace(c, f"\\u{ord(c):04x}")
    return s


def rfc3339(ts: Column) -> Column:
    """A timestamp in UTC as text, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_time(utc: str) -> str:
    """RFC 3339 text in UTC as local time; other texts stay as they are."""
    try:
        return datetime.datetime.fromisoformat(utc).astimezone().strftime("%Y-%m-%d %H:%M:%S")
    except ValueError:
        return utc
